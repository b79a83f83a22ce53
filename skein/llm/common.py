"""Shared pieces: reading, materialising, Arrow text buffers and gapless ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The words of the contracts are runs of anything but these bytes.
ASCII_SPACE = b" \t\n\v\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_skein_root"):
        context._skein_root = f"file://{tempfile.mkdtemp(prefix='skein-')}"
    return context._skein_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/skein-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors and gives the planner true sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def valid_text(name: str = "text"):
    """The column as a string; bytes that are no UTF-8 become U+FFFD, as they would in any decoder."""
    return F.make_valid_utf8(F.col(name).cast("string"))


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df is called so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def heavy_keys(left: DataFrame, key: list[str], least: int = 10_000, most_keys: int = 100_000) -> DataFrame:
    """The keys that over `least` rows have (more where over most_keys keys could): counted before they are shuffled, and at most most_keys."""
    least = max(least, left.count() // most_keys)
    return materialize(left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(*key), "heavy")


def spread_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """left joined (inner or left) with right, which has one row per key, by columns without nulls.

    Rows of left whose key is heavy stay where they are: the few rows of right for heavy keys are broadcast. All others
    are shuffled. So no task gets a key with a large share of the rows. left is read twice: pass a written table.
    """
    heavy = heavy_keys(left, key) if heavy is None else heavy
    if heavy.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(heavy)  # bounded by heavy_keys()
    rest = left.join(few, key, "left_anti").join(right, key, how)
    return rest.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    if not len(column) or raw_offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string array over given bytes, without copying them."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def release_memory() -> None:
    """Gives a worker's freed memory back to the system; idle workers stay alive and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def row_blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column's text in each holds at most so many bytes, or one row."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release_memory()


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated index ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def group_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; empty groups give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def range_ids(df: DataFrame, key: str, rows_per_range: int, most: int = 100_000) -> list:
    """Values of key that cut df into ranges of about so many rows, at most `most` of them: each is the largest of its range."""
    n = df.count()
    cuts = min(most, n // rows_per_range)
    if cuts < 1:
        return []
    got = df.agg(F.percentile_approx(key, [i / (cuts + 1) for i in range(1, cuts + 1)], 20 * (cuts + 1)).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_numbers(column: pa.Array, bounds: list) -> np.ndarray:
    """The number of the range of range_ids() for each key; null keys come first."""
    keys = column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.searchsorted(np.array(bounds, np.int64), keys, "left").astype(np.int32)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, rows_per_bucket: int = 200_000, most_buckets: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within each group, in two levels: no window holds more than a bucket of a group.

    A row's bucket comes from a hash of its order columns, so a group with a third of all rows is dealt over many
    tasks. Rows that agree in group and order columns are told apart by nothing but their numbers. df is read twice.
    """
    buckets = max(1, min(most_buckets, -(-df.count() // rows_per_bucket) * 4))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("rank"), *order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(inside) - 1)
    return numbered.join(bases, [*group, "_bucket"]).withColumn(name, F.col("_base") + F.col("_rank")).drop("_bucket", "_base", "_rank")
