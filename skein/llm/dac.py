"""Token-id files in directly addressable codes.

An id is cut into chunks of a few bits. Level 0 has the lowest chunk of every id; a continuation bitmap marks the ids
that go on, whose next chunks are level 1, and so on. A rank directory over each bitmap (ones before every 512th bit)
gives the place in the next level, so token i is read without decoding any other.

The writer deals documents into ranges of doc_id, sorts each, and writes one row per segment (a run of documents of a
range, about `segment_ids` ids) with the segment's bytes; the reader opens those files again. Documents keep their order
by (range, segment, place).

Defined results: a null text is empty and has the end id only; a null doc_id comes first; rows with the same doc_id
follow each other, by their text; a very long text is a segment by itself; bytes that are no UTF-8 count as U+FFFD; an
empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import range_ids, range_numbers, row_blocks, scratch_path, valid_text
from skein.llm.word_bpe import default_path, encoder

MAGIC = b"DAC1"
RANK_EVERY = 512
SEGMENTS = "part int, segment int, first_start long, n_docs int, n_ids long, payload binary"


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of RANK_EVERY bits."""
    padded = np.zeros(-(-len(bits) // RANK_EVERY) * RANK_EVERY, np.uint8)
    padded[: len(bits)] = bits
    per_block = padded.reshape(-1, RANK_EVERY).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)])


def dac_encode(ids: np.ndarray, widths: tuple[int, ...] = (8, 8, 16)) -> bytes:
    """widths: bits of each level's chunks, 8, 16 or 32; the last levels are absent where no id needs them."""
    values, parts = np.asarray(ids, np.uint64), []
    for level, width in enumerate(widths):
        rest = values >> np.uint64(width)
        chunk = (values & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}")
        bits = (rest > 0).astype(np.uint8)
        parts.append(struct.pack("<BQ", width, len(chunk)) + chunk.tobytes() + np.packbits(bits, bitorder="little").tobytes() + _ranks(bits).astype("<u4").tobytes())
        values = rest[rest > 0]
        if not len(values):
            break
    if len(values):
        raise ValueError("an id has more bits than the levels hold")
    return MAGIC + struct.pack("<B", len(parts)) + b"".join(parts)


class DacReader:
    """Random access to the ids of dac_encode()."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.levels, at = [], 5
        for _ in range(payload[4]):
            width, n = struct.unpack_from("<BQ", payload, at)
            at += 9
            chunks = np.frombuffer(payload, f"<u{width // 8}", n, at)
            at += chunks.nbytes
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at)
            at += bits.nbytes
            ranks = np.frombuffer(payload, "<u4", -(-n // RANK_EVERY) + 1, at)
            at += ranks.nbytes
            self.levels.append((width, chunks, bits, ranks))
        self.size = at

    def __len__(self) -> int:
        return len(self.levels[0][1])

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            inside = np.unpackbits(bits[block * RANK_EVERY // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_EVERY]
            i = int(ranks[block]) + int(inside.sum())
            shift += width
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """ids [start, end), each level read in one run."""
        values, at, shift = np.zeros(end - start, np.uint64), np.arange(end - start), 0
        for width, chunks, bits, ranks in self.levels:
            values[at] |= chunks[start:end].astype(np.uint64) << np.uint64(shift)
            go_on = np.unpackbits(bits[start >> 3 : -(-end // 8)], bitorder="little")[start & 7 : (start & 7) + end - start].astype(bool)
            at = at[go_on]
            if not len(at):
                break
            block = start // RANK_EVERY
            start = int(ranks[block]) + int(np.unpackbits(bits[block * RANK_EVERY // 8 : (start >> 3) + 1], bitorder="little")[: start - block * RANK_EVERY].sum())
            end, shift = start + len(at), shift + width
        return values.astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, widths: tuple[int, ...] = (8, 8, 16), segment_ids: int = 1 << 19, rows_per_range: int = 4096) -> None:
    """Encodes docs and writes segment files under path, in ascending doc_id order by (part, segment)."""
    tokenizer = tokenizer or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    bounds = range_ids(docs.select("doc_id"), "doc_id", rows_per_range)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_numbers(batch.column("doc_id"), bounds)), *batch.columns], ["part", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start, doc_ids, counts, ids = None, 0, 0, [], [], []

        def flush():
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            head = struct.pack("<I", len(n)) + np.concatenate(doc_ids).astype("<i8").tobytes() + n.astype("<u4").tobytes()
            payload = head + dac_encode(np.concatenate(ids), widths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([len(n)], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([payload], pa.binary())], ["part", "segment", "first_start", "n_docs", "n_ids", "payload"])

        for batch in row_blocks(batches, "text", 1 << 22):
            got, offsets = encoder(tokenizer, 600_000).encode(batch.column("text"))
            with_end = np.insert(got, offsets[1:], end_id)
            lengths = np.diff(offsets) + 1
            at = np.concatenate([[0], np.cumsum(lengths)])
            parts = batch.column("part").to_numpy()
            keys = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(parts)]):
                if part != parts[a] or sum(map(len, ids)) >= segment_ids:
                    if doc_ids:
                        yield flush()
                        segment, start = segment + 1, start + sum(map(len, ids))
                    if part != parts[a]:
                        part, segment, start = int(parts[a]), 0, 0
                    doc_ids, counts, ids = [], [], []
                doc_ids.append(keys[a:b])
                counts.append(lengths[a:b])
                ids.append(with_end[at[a] : at[b]])
        if doc_ids:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.mapInArrow(dealt, "part int, doc_id long, text string").repartition(n, "part").sortWithinPartitions("part", "doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files of write_tokens()."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one number per range of documents; their count is bounded by range_ids()
    totals = dict(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    parts = np.array(sorted(totals), np.int64)
    bases = np.concatenate([[0], np.cumsum([totals[p] for p in parts.tolist()])]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(batch.column("part").to_pylist(), batch.column("first_start").to_pylist(), batch.column("payload")):
                raw = payload.as_py()
                (n,) = struct.unpack_from("<I", raw)
                doc_ids, counts = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n).astype(np.int64)
                reader = DacReader(raw[4 + 12 * n :])
                at = np.concatenate([[0], np.cumsum(counts)])
                base = int(bases[np.searchsorted(parts, part)]) + first
                ids = reader.slice(0, len(reader)).astype("<u4")
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                null = doc_ids == np.iinfo(np.int64).min
                out = [pa.array(doc_ids, mask=null), pa.array(base + at[:-1]), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return files.select("part", "first_start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokens_at(spark: SparkSession, path: str, places: Sequence[int]) -> DataFrame:
    """place, id: the ids at given numbers of the whole sequence of the files of write_tokens(); numbers outside it have no row.

    A number's range follows from the ranges' sizes, its segment from the segments' starts; only segments of these ranges
    are read, and in each only the bits and chunks on the id's way.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = dict(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one number per range, see read_tokens()
    parts = sorted(totals)
    ends = np.cumsum([totals[p] for p in parts]) if parts else np.zeros(0, np.int64)
    inside = [int(p) for p in set(places) if 0 <= p < (int(ends[-1]) if len(ends) else 0)]
    at = np.searchsorted(ends, inside, "right")
    wanted = [(p, int(parts[k]), p - int(ends[k] - totals[parts[k]])) for p, k in zip(inside, at.tolist())]
    asked = spark.createDataFrame(wanted, "place long, part int, local long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for local, first, payload in zip(batch.column("local").to_pylist(), batch.column("first_start").to_pylist(), batch.column("payload")):
                raw = payload.as_py()
                (n,) = struct.unpack_from("<I", raw)
                ids.append(DacReader(raw[4 + 12 * n :])[local - first])
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(ids, pa.int64())], ["place", "id"])

    mine = files.filter(F.col("part").isin(sorted({w[1] for w in wanted}))).join(F.broadcast(asked), "part")  # the places that were asked for
    return mine.filter("local >= first_start and local < first_start + n_ids").select("place", "local", "first_start", "payload").mapInArrow(run, "place long, id long")


def roundtrip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to fresh files in the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
