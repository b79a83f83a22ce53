"""Streaming forms of the batch operators: per-day call counts under a watermark, and upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.tables import upsert


def daily_counts(calls: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Calls per day of a stream; a day is final once the watermark has passed it."""
    return calls.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's rows replace those with their key."""

    def apply(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch.dropDuplicates(list(key)), key))

    return apply
