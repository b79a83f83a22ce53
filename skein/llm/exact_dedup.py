"""Exact dedup by composable polynomial fingerprints.

A text's bytes (A-Z lower-cased) are cut into chunks that are hashed side by side; the hash of a concatenation is
H(ab) = H(a) * r^len(b) + H(b) modulo a prime, so chunk hashes combine in any grouping. Texts of equal fingerprints
and lengths form classes; the texts of classes with more than one row are compared chunk by chunk as streams of
(class, chunk number) groups that are reduced before they are shuffled. A bit table of those classes' keys, bounded
in size, spares most other texts the comparison; what it lets through besides is compared and found alone.

Defined results: a null text counts as empty; empty texts are equal; rows with the same doc_id and equal texts are
copies of each other and exactly one of the class stays; a null doc_id sorts below all others; an empty table gives
an empty result; very long texts are hashed and compared by chunks. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import LOWER_TABLE, fresh_name, materialize, row_blocks, spread_join, text_buffers

#: Two primes below 2^31 and a base for each.
MODULI = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
CHUNK = 4096
COMPARE_CHUNK = 1 << 16
BLOCK_CHUNKS = 256

FINGERPRINTS = "doc_id long, h1 long, h2 long, n_bytes long, text_sha256 string"
CHUNKS = "h1 long, h2 long, n_bytes long, chunk_no int, chunk binary"


def power(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponents modulo a modulus under 2^31, elementwise."""
    result, square, left = np.ones(len(exponents), np.int64), base % modulus, exponents.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        result[odd] = result[odd] * square % modulus
        square = square * square % modulus
        left = left >> 1
    return result


def combine(left: tuple[int, int], right: tuple[int, int], modulus: int, base: int) -> tuple[int, int]:
    """The (hash, length) of a concatenation from those of its parts; associative."""
    return (left[0] * pow(base, right[1], modulus) + right[0]) % modulus, left[1] + right[1]


def polynomial_hashes(data: np.ndarray, offsets: np.ndarray, modulus: int, base: int, chunk: int = CHUNK) -> np.ndarray:
    """The hash of each row of data[offsets[i]:offsets[i+1]], from chunk hashes that are shifted by the length behind them."""
    lengths = np.diff(offsets)
    per_row = -(-lengths // chunk)
    row = np.repeat(np.arange(len(lengths)), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    starts = offsets[:-1][row] + number * chunk
    ends = np.minimum(starts + chunk, offsets[1:][row])
    table = power(base, np.arange(chunk), modulus)
    hashes = np.empty(len(row), np.int64)
    for at in range(0, len(row), BLOCK_CHUNKS):
        s, e = starts[at : at + BLOCK_CHUNKS], ends[at : at + BLOCK_CHUNKS]
        low = int(s[0])
        exponents = np.repeat(e - 1, e - s) - np.arange(low, int(e[-1]))
        hashes[at : at + BLOCK_CHUNKS] = np.add.reduceat(data[low : int(e[-1])] * table[exponents], s - low) % modulus
    shifted = hashes * power(base, offsets[1:][row] - ends, modulus) % modulus
    sums = np.concatenate([[0], np.cumsum(shifted)])
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) % modulus


def _lowered(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    data, offsets = text_buffers(batch.column("text"))
    raw = data.tobytes().translate(LOWER_TABLE)
    return raw, np.frombuffer(raw, np.uint8), offsets


def fingerprints(docs: DataFrame, moduli=MODULI) -> DataFrame:
    """One row per document: both hashes, the byte length and the SHA-256 of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 23):
            raw, data, offsets = _lowered(batch)
            view = memoryview(raw)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            h1, h2 = (polynomial_hashes(data, offsets, m, r) for m, r in moduli)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h1), pa.array(h2), pa.array(np.diff(offsets)), pa.array(digests)], ["doc_id", "h1", "h2", "n_bytes", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FINGERPRINTS)


def key_bits(classes: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """A bit table over the low bits of h1 and of h2 of each class, as 64-bit words; built by tasks, at most most_bits / 8 bytes."""
    n = classes.count()
    bits = min(most_bits, max(1 << 10, 1 << (32 * n).bit_length()))
    places = classes.select(F.explode(F.array("h1", "h2")).alias("h")).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("v").to_numpy()
    return table


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63) & 1).astype(bool)


def _chunks(docs: DataFrame, moduli, wanted: np.ndarray) -> DataFrame:
    """The chunks of all texts whose class may be in the bit table."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 23):
            raw, data, offsets = _lowered(batch)
            h1, h2 = (polynomial_hashes(data, offsets, m, r) for m, r in moduli)
            rows, numbers, parts = [], [], []
            for i in np.flatnonzero(_has(shared.value, h1) & _has(shared.value, h2)).tolist():
                a, b = int(offsets[i]), int(offsets[i + 1])
                for number, at in enumerate(range(a, b, COMPARE_CHUNK)):
                    rows.append(i)
                    numbers.append(number)
                    parts.append(raw[at : min(b, at + COMPARE_CHUNK)])
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([pa.array(h1[rows], pa.int64()), pa.array(h2[rows], pa.int64()), pa.array(n[rows], pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["h1", "h2", "n_bytes", "chunk_no", "chunk"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def find_copies(docs: DataFrame, moduli=MODULI, most_bits: int = 1 << 27) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    key = ["h1", "h2", "n_bytes"]
    prints = fingerprints(docs, moduli)
    rows = materialize(prints.groupBy("doc_id", *key, "text_sha256").agg(F.count(F.lit(1)).alias("copies")), "prints")
    rows_class = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")
    sizes = rows.groupBy(*key).agg(F.sum("copies").alias("group_size"), F.max(rows_class)["doc_id"].alias("keep_id"))
    classes = materialize(sizes.filter("group_size > 1"), "classes")
    if not classes.isEmpty():
        compared = _chunks(docs, moduli, key_bits(classes, most_bits)).groupBy(*key, "chunk_no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
        mixed = materialize(compared.filter("lo <> hi").select(*key).distinct(), "mixed")
        if not mixed.isEmpty():
            # different texts under one fingerprint: their classes are told apart by content
            own = [*key, "text_sha256"]
            several, single = (materialize(rows.join(mixed, key, how), how) for how in ("left_semi", "left_anti"))
            torn = several.groupBy(*own).agg(F.sum("copies").alias("group_size"), F.max(rows_class)["doc_id"].alias("keep_id"))
            joined = spread_join(single, classes.join(mixed, key, "left_anti"), key, "left").unionByName(spread_join(several, torn, own, "left"))
        else:
            joined = spread_join(rows, classes, key, "left")
    else:
        joined = rows.withColumn("group_size", F.lit(None).cast("long")).withColumn("keep_id", F.lit(None).cast("long"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


@F.arrow_udf(T.StringType())
def row_key(texts: pa.Array) -> pa.Array:
    """Tells rows with the same doc_id apart: the digest of the normalised text's bytes, as in fingerprints()."""
    data, offsets = text_buffers(texts)
    view = memoryview(data.tobytes().translate(LOWER_TABLE))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())


def drop_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs without the rows that decisions (doc_id, text_sha256, kept) drop, all columns kept, whatever their names.

    Only ids are joined, and texts are looked at where an id has several rows: of rows with an id and equal texts one
    stays if any is kept, the one that is least written out as JSON; a null doc_id is an id like others.
    """
    mine = {c: F.col(f"`{c}`") for c in docs.columns}
    drop, again, text_key, row = (fresh_name(docs, n) for n in ("_drop", "_again", "_key", "_row"))
    doc_id = mine[next(c for c in docs.columns if c.lower() == "doc_id")].cast("long")
    ids = materialize(decisions.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"), "drop")
    gone = docs.join(ids.select(F.col("doc_id").alias(drop)), doc_id.eqNullSafe(F.col(drop)), "left_anti")
    repeated = ids.filter("stays").select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return gone
    stay = decisions.filter("kept").join(repeated, F.col("doc_id").eqNullSafe(F.col(again)), "left_semi").select(F.col("doc_id").alias(again), F.col("text_sha256").alias(drop)).distinct()
    whole = F.struct(*mine.values())
    several = docs.join(repeated, doc_id.eqNullSafe(F.col(again)), "left_semi").select(doc_id.alias("i"), row_key(F.col("text").cast("string")).alias(text_key), whole.alias(row), F.to_json(whole).alias("json"))
    one = several.join(stay, F.col("i").eqNullSafe(F.col(again)) & (F.col(text_key) == F.col(drop)), "left_semi").groupBy("i", text_key).agg(F.min_by(row, "json").alias(row))
    return gone.unionByName(one.select(f"{row}.*"))
