"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a uniform number u from a hash; the record goes to the shard with the largest
-weight / ln(u). A further shard only takes records for which its own score is the largest, so nothing moves between
the shards that were there before. All of it is one projection of built-in functions.

Defined results: a null text has size 8; a null key is hashed as the word null; rows with the same key are in the
same shard, each with a slot of its own, in an order of their own; very long texts are sized and summed whole; two shards
with one score (which takes equal hashes) go to the higher number; an empty table gives an empty result; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, ranked

MANTISSA = 2.0**52


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of 'key:shard'."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(MANTISSA)


def rendezvous(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """The shard of a key, and its shard if the last of the weights were not there."""
    if any(w <= 0 for w in weights):
        raise ValueError("weights are positive")
    scores = [F.struct((F.lit(-float(w)) / F.log(uniform(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    before = F.array_max(F.array(*scores[:-1])) if len(scores) > 1 else scores[0]
    return before, scores[-1]


def assign(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    weights = list(weights or [1.0] * shards)
    before, last = rendezvous(F.col("doc_id"), [*weights, grown_weight])
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("_a", before).withColumn("_b", last)
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_a.shard").alias("shard"), F.when(F.col("_b.score") > F.col("_a.score"), F.col("_b.shard")).otherwise(F.col("_a.shard")).alias("grown_shard"))
    rows = materialize(rows, "shards")  # narrow; the texts are read once
    return ranked(rows, ["shard"], ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, weights: Sequence[float] | None = None, name: str = "shard") -> None:
    """Writes docs with one folder per shard (name=number), each by many tasks. A column called like the folders is an error."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}; give the folders another name")
    before, _ = rendezvous(F.col("doc_id"), [*(weights or [1.0] * shards), 1.0])
    docs.withColumn(name, before["shard"]).write.partitionBy(name).parquet(path)
