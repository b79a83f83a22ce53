"""SimHash near-dedup through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments, so of two fingerprints that differ in at most two bits one segment
differs in at most one. Each segment is indexed under its 32 variants with one bit taken out; fingerprints that share
a variant meet in a bucket by equality and are verified there. Only distinct fingerprints are indexed. A bucket of G
fingerprints gives at most G - 1 links per group that it shows: small buckets compare their members, larger ones go
over the balls of radius one around members, in which any two members differ by two bits at most and any two that
differ by two bits or fewer meet. Variants of segment values that very many fingerprints have are split by a third
part of the other segment (of three parts, two differing bits leave one equal), so that no bucket gets them all.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
with one or two words the whole sequence is the only shingle; very long texts are hashed whole; rows with the same doc_id
are nodes of their own; a null doc_id gives a null component unless others have the fingerprint's component; an empty
table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ASCII_SPACE, LOWER_TABLE, materialize, row_blocks, spread_join, text_buffers
from skein.llm.components import components

SEED = 42
SMALL_BUCKET = 32
BALL_KEYS = 4_000_000
_BLANK = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(ASCII_SPACE, np.uint8))


def shingle_hashes(raw: bytes, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the space-joined shingles of each text in raw[offsets[i]:offsets[i+1]], and each text's offsets into them."""
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = ~blank & (np.concatenate([[True], blank[:-1]]) | begins[:-1])
    last = ~blank & (np.concatenate([blank[1:], [True]]) | begins[1:])
    # one space between the words of a text: keep words and the blank behind each
    keep = ~blank | np.concatenate([[False], last[:-1] & ~begins[1:-1]])
    place = np.cumsum(keep) - 1
    first_at, last_at = np.flatnonzero(first), np.flatnonzero(last)
    words = np.searchsorted(first_at, offsets)
    joined = np.where(blank, 32, data)[keep].astype(np.uint8).tobytes()
    starts, ends = place[first_at], place[last_at] + 1
    n_words = np.diff(words)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(words[:-1] - at[:-1], n) + np.arange(at[-1])
    end = np.repeat(words[1:], n) - 1
    end = np.minimum(begin + width - 1, end)
    hasher = xxhash.xxh64_intdigest
    return np.array([hasher(joined[a:b], SEED) for a, b in zip(starts[begin].tolist(), ends[end].tolist())], np.uint64), at


def majority(hashes: np.ndarray, at: np.ndarray, block: int = 100_000) -> np.ndarray:
    """Bit by bit, whether over half of each group's hashes have it."""
    counts = np.zeros((len(at) - 1, 64), np.int64)
    sizes = np.diff(at)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for low in range(0, len(hashes), block):
        some = np.unpackbits(hashes[low : low + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        g = group[low : low + block]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        counts[g[cut]] += np.add.reduceat(some, cut, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_sha256 (of the normalised text) and fp (the fingerprint as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 20):
            data, offsets = text_buffers(batch.column("text"))
            raw = data.tobytes().translate(LOWER_TABLE)
            fp = majority(*shingle_hashes(raw, offsets, width)) if len(data) else np.zeros(batch.num_rows, np.uint64)
            view = memoryview(raw)
            digests = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digests, pa.array(fp.view(np.int64))], ["doc_id", "text_sha256", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_sha256 string, fp long")


def variants(fp: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all one-wildcard segment variants, and the fingerprint of each. heavy: sorted (segment << 32 | value)."""
    keys, values = [], []
    u = fp.view(np.uint64)
    for segment in (0, 1):
        own = (u >> np.uint64(32 * segment) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        other = (u >> np.uint64(32 - 32 * segment) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts = (other & 0x7FF, other >> 11 & 0x7FF, other >> 22)
        for bit in range(32):
            rest = own & ~(1 << bit)
            key = segment << 37 | bit << 32 | rest
            if len(heavy):
                hot = np.isin(segment << 32 | rest, heavy) | np.isin(segment << 32 | rest | 1 << bit, heavy)
                for p, part in enumerate(parts):
                    keys.append(((p + 1) << 49 | part << 38 | key)[hot])
                    values.append(fp[hot])
                keys.append(key[~hot])
                values.append(fp[~hot])
            else:
                keys.append(key)
                values.append(fp)
    return np.concatenate(keys), np.concatenate(values)


def ball_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what differs by two bits or fewer among distinct members: stars around the smallest in each ball."""
    members = np.unique(members)
    u = members.view(np.uint64)
    differ = int(np.bitwise_or.reduce(u ^ u[0]))
    flips = [0, *(1 << b for b in range(64) if differ >> b & 1)]
    rounds = -(-len(members) * len(flips) // BALL_KEYS)
    out_a, out_b = [], []
    for turn in range(rounds):
        keys, owners = [], []
        for flip in flips:
            k = u ^ np.uint64(flip)
            mine = np.flatnonzero((k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(rounds) == turn) if rounds > 1 else np.arange(len(k))
            keys.append(k[mine])
            owners.append(mine)
        k, o = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        star = np.repeat(o[head], np.diff(np.append(head, len(k))))
        real = star != o
        pair = np.unique(star[real].astype(np.int64) << 32 | o[real])
        out_a.append(members[pair >> 32])
        out_b.append(members[pair & 0xFFFFFFFF])
    return np.concatenate(out_a), np.concatenate(out_b)


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys."""
    n = len(keys)
    if n < 2:
        return fps[:0], fps[:0]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(head, n))
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    out_a, out_b = [], []
    u = fps.view(np.uint64)
    for step in range(1, min(SMALL_BUCKET, int(sizes.max()))):
        same = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(same):
            break
        near = same[np.bitwise_count(u[same] ^ u[same + step]) <= 2]
        out_a.append(fps[near])
        out_b.append(fps[near + step])
    for k in np.flatnonzero(sizes > SMALL_BUCKET).tolist():
        a, b = ball_links(fps[head[k] : head[k] + sizes[k]])
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return fps[:0], fps[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def near_links(distinct: DataFrame, most_heavy: int = 20_000) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that connect whatever differs by at most two bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    segments = distinct.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))).alias("v"))
    # at most 2n / bound values can be this frequent, so the list is bounded
    heavy = segments.groupBy("v").count().filter(F.col("count") > max(2000, 2 * n // most_heavy)).select("v").toArrow().column("v").to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(heavy))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = variants(batch.column("fp").to_numpy(), shared.value)
            for at in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(values[at : at + (1 << 17)])], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = [], []
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            rest_k.append(keys)
            rest_f.append(fps)
            if keys[0] == keys[-1] and rest_k[0][0] == keys[0]:
                continue  # one bucket so far
            keys, fps = np.concatenate(rest_k), np.concatenate(rest_f)
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            rest_k, rest_f = [keys[cut:]], [fps[cut:]]
            a, b = bucket_links(keys[:cut], fps[:cut])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if rest_k:
            a, b = bucket_links(np.concatenate(rest_k), np.concatenate(rest_f))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = distinct.select("fp").mapInArrow(expand, "key long, fp long").repartition(parts, "key").sortWithinPartitions("key")
    return index.mapInArrow(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and each fingerprint's component, its size and its first row."""
    rows = materialize(fingerprints(docs), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256"))
    distinct = materialize(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    roots = components(near_links(distinct))
    merged = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "merged")
    whole = merged.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("component_size"))
    classes = spread_join(merged.select("fp", "root"), whole, ["root"]).select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_sha256").alias("first_sha"), "component_size")
    return rows, materialize(classes, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable over links, its own included) and component_size for each row."""
    rows, classes = _classes(docs)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return spread_join(rows, classes, ["fp"]).select("doc_id", hexed, "component_id", "component_size")


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, kept: of each component the row with the smallest doc_id stays (of several with it, the one of the smallest digest)."""
    rows, classes = _classes(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_sha256") == F.col("first_sha"))
    return spread_join(rows, classes, ["fp"]).select("doc_id", "text_sha256", kept.alias("kept"))
