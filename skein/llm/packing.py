"""Best-fit packing by patterns fitted with non-negative least squares.

The histogram of piece lengths (at most `capacity` numbers) is all that reaches the driver. Patterns of one to three
lengths that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded within the counts there are; what is left is packed best-fit, longest first, on the histogram
itself. The plan says, for each length, which ranks of its pieces go where; pieces get gapless ranks within their
length in two levels and look their place up, so the plan's size does not depend on the number of documents.

Defined results: a null text is empty and has the end id only; documents longer than a sequence are cut into full
pieces and a rest, no other is cut; rows with the same doc_id or text are packed each; pieces of one length take the
places for it in the order of their doc_id, piece and checksum's hashes; bytes that are no UTF-8 count as U+FFFD; an
empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, ranked, row_blocks, spans, valid_text
from skein.llm.word_bpe import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids and their checksums (and the ids)."""
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 22):
            got, offsets = encoder(tokenizer).encode(batch.column("text"))
            ids = np.insert(got, offsets[1:], end_id).astype("<u4")
            lengths = np.diff(offsets) + 1
            starts = np.cumsum(lengths) - lengths
            per_doc = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), per_doc)
            number = spans(np.zeros(len(lengths), np.int64), per_doc)
            inside = number * capacity
            size = np.minimum(capacity, lengths[row] - inside)
            view = memoryview(ids).cast("B")
            at = starts[row] + inside
            crcs = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(inside), pa.array(size), pa.array(crcs, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    return docs.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def patterns(counts: np.ndarray, heavy: int = 128) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence: counts[n] pieces have n tokens, len(counts) - 1 is the capacity.

    All of one and two lengths; of three, those with two among the `heavy` lengths that hold most tokens.
    """
    capacity = len(counts) - 1
    there = counts > 0
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    a = np.arange((capacity + 1) // 2, capacity)
    a = a[there[a] & there[capacity - a]]
    found.append(np.stack([a, capacity - a, np.zeros_like(a)], 1))
    most = np.argsort(-counts * np.arange(capacity + 1), kind="stable")[:heavy]
    most = most[there[most] & (most > 0)]
    x, y = (v.ravel() for v in np.meshgrid(most, most, indexing="ij"))
    z = capacity - x - y
    good = (x >= y) & (z > 0)
    x, y, z = x[good], y[good], z[good]
    x, y, z = (v[there[z]] for v in (x, y, z))
    found.append(np.stack([x, y, z], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return np.unique(np.sort(rows, 1)[:, ::-1], axis=0)


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeats of the patterns that bring their lengths nearest to counts in least squares (accelerated projected gradient)."""
    size, n = len(counts), len(rows)
    if not n:
        return np.zeros(0)
    used = (rows > 0).astype(float)
    forward = lambda x: np.bincount(rows.ravel(), (x[:, None] * used).ravel(), size)
    back = lambda r: (r[rows] * used).sum(1)
    v = np.ones(n)
    for _ in range(30):
        v = back(forward(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - counts) / (1.02 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal sequences: ([(length, copies), ...], how many sequences). counts[n]: pieces of n tokens."""
    counts, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    rows = patterns(counts)
    repeats = fit(counts.astype(float), rows)
    groups: list[tuple[list[tuple[int, int]], int]] = []
    for i in np.argsort(-repeats, kind="stable").tolist():
        want = int(np.round(repeats[i]))
        if not want:
            break
        lengths, copies = np.unique(rows[i][rows[i] > 0], return_counts=True)
        times = min(want, int((counts[lengths] // copies).min()))
        if times:
            counts[lengths] -= copies * times
            groups.append(([(int(a), int(c)) for a, c in zip(lengths[::-1], copies[::-1])], times))
    return groups + best_fit(counts)


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on the histogram: all sequences of equal content are handled at once."""
    capacity = len(counts) - 1
    open_: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        space = length
        while left:
            while space <= capacity and not open_[space]:
                space += 1
            if space > capacity:
                fits = capacity // length
                content, bins = [], -(-left // fits)
                space_now = capacity
            else:
                content, bins = open_[space].pop()
                fits, space_now = space // length, space
            full = min(bins, left // fits)
            if full:
                open_[space_now - fits * length].append(([*content, (length, fits)], full))
                left -= full * fits
            rest = bins - full
            if rest and left:
                some = min(left, fits)
                open_[space_now - some * length].append(([*content, (length, some)], 1))
                left, rest = left - some, rest - 1
            if rest and content:
                open_[space_now].append((content, rest))
            space = length
    return [g for at in open_ for g in at]


def pack(piece_rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """piece_rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    histogram = piece_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    keys, copies, firsts, prefixes, sequence, used = [], [], [], [], 0, np.zeros(capacity + 1, np.int64)
    for content, times in plan(counts):
        prefix = 0
        for length, m in content:
            keys.append((length << 44) + int(used[length]))
            copies.append(m)
            firsts.append(sequence)
            prefixes.append(prefix)
            used[length] += m * times
            prefix += m * length
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    table = [np.array(v, np.int64)[order] for v in (keys, copies, firsts, prefixes)]
    shared = piece_rows.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity, not by the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, copies, firsts, prefixes = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = (length << 44) + rank
            at = np.searchsorted(keys, key, "right") - 1
            i = key - keys[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(firsts[at] + i // copies[at]), pa.array(prefixes[at] + i % copies[at] * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    rows = ranked(piece_rows, ["length"], ["doc_id", "piece", "ids_crc32"], "rank").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenizes docs once and packs them; one row per piece."""
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
