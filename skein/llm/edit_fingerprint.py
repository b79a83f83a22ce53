"""Document fingerprints by a randomised edit embedding.

A shared random walk turns a text into a longer one: at output place j the current character is written, and the walk
goes on to the next character if the random bit of (j, character) is one. Texts a few edits apart fall into step again
after each edit, so edit distance becomes Hamming distance. The fingerprint keeps the embedding's length and a few
bits of the characters at sampled places, 32 in each doubling of the length, so it holds whole texts of any length;
likeness is the estimated share of places in which two embeddings agree. Bands of sampled places find similar texts
by equality, and likeness verifies them.

Defined results: a null text is empty; the next document is the one with the next smaller doc_id (null is the
smallest; of several rows with a doc_id the smaller text comes first), after the last the first, so a single row
follows itself; two empty texts are alike (1), an empty and another are not (0); very long texts are walked whole; bytes
that are no UTF-8 count as U+FFFD; an empty table gives an empty result; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize, range_ids, range_numbers, row_blocks, spans, text_buffers, valid_text
from skein.llm.components import components

CLASSES, PERIOD = 128, 1024
LEVELS, PER_LEVEL, FIRST = 36, 32, 16
BAND = 6
#: Fewer live walks than this are followed one by one.
FEW = 48
#: Buckets of bands up to this size give all pairs; larger ones than SPLIT_BUCKET are split.
SMALL_BUCKET, SPLIT_BUCKET = 32, 1024
#: Rows that are handled together.
AT_ONCE = 8192


def _tables(seed: int = 20_240) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """stay[class * PERIOD + j]: places until the walk goes on; the sampled places by level; bits[class, sample]."""
    rng = np.random.default_rng(seed)
    go_on = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    stay = np.zeros((CLASSES, PERIOD), np.int64)
    ahead = np.zeros(CLASSES, np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        ahead = np.where(go_on[:, j % PERIOD], 1, ahead + 1)
        stay[:, j % PERIOD] = ahead
    places = [np.arange(FIRST)]
    for level in range(1, LEVELS):
        low = FIRST << (level - 1)
        size = min(PER_LEVEL, low)
        places.append(np.sort(low + (rng.choice(low, size, replace=False) if low <= 1 << 16 else rng.integers(0, low, size))))
    return stay.ravel(), places, rng.integers(0, 16, (CLASSES, 64)).astype(np.uint8)


STAY, PLACES, BITS = _tables()
ALL_PLACES = np.concatenate(PLACES)
LEVEL_OF = np.repeat(np.arange(LEVELS), [len(p) for p in PLACES])
_STAY_ROWS = [bytes(r) for r in STAY.reshape(CLASSES, PERIOD).astype(np.uint8)]
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def char_classes(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(25)).astype(np.int64)


def walk(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each character the output place at which the walk leaves it; texts are walked side by side."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    left = np.empty(len(classes), np.int64)
    starts, sizes = offsets[:-1][order], lengths[order]
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), "right") if len(sizes) else np.zeros(0, int)
    steps = int(np.searchsorted(-live, -FEW, "right"))  # more than FEW walks are live in these
    at = np.zeros(len(sizes), np.int64)
    rows = classes * PERIOD
    place, index, state = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for step in range(steps):
        k = live[step]
        p, i, s, j = place[:k], index[:k], state[:k], at[:k]
        np.add(starts[:k], step, out=p)
        np.take(rows, p, out=i)
        np.bitwise_and(j, PERIOD - 1, out=s)
        np.add(i, s, out=i)
        np.take(STAY, i, out=s)
        np.add(j, s, out=j)
        left[p] = j
    table, mask = _STAY_ROWS, PERIOD - 1
    for d in range(int(live[steps]) if steps < len(live) else 0):
        j, out = int(at[d]), []
        a, b = int(starts[d]) + steps, int(starts[d] + sizes[d])
        for c in classes[a:b].tolist():
            j += table[c][j & mask]
            out.append(j)
        left[a:b] = out
    return left


def sketches(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedding's length of each text, and its samples (0 to 15; 255 beyond the end) at ALL_PLACES up to the block's longest."""
    classes = char_classes(codes)
    left = walk(classes, offsets)
    lengths = np.diff(offsets)
    size = np.zeros(len(lengths), np.int64)
    size[lengths > 0] = left[offsets[1:][lengths > 0] - 1]
    base = np.cumsum(size) - size
    absolute = left + np.repeat(base, lengths)
    width = int(np.searchsorted(ALL_PLACES, size.max() if len(size) else 0))
    width = int((LEVEL_OF <= LEVEL_OF[width - 1]).sum()) if width else 0
    inside = ALL_PLACES[:width] < size[:, None]
    doc, sample = np.nonzero(inside)
    char = np.searchsorted(absolute, base[doc] + ALL_PLACES[sample], "right")
    out = np.full((len(lengths), width), 255, np.uint8)
    out[doc, sample] = BITS[classes[char], sample % 64]
    return size, out


def to_strings(size: np.ndarray, samples: np.ndarray) -> list[str]:
    """Ten hex digits of the embedding's length, then one per sample up to the last level that it reaches."""
    texts = HEX[np.where(samples == 255, 0, samples)]
    used = np.searchsorted(LEVEL_OF, np.searchsorted([p[0] if i == 0 else FIRST << (i - 1) for i, p in enumerate(PLACES)], size, "left"), "left")
    return [f"{n:010x}" + row[:k].tobytes().decode() for n, row, k in zip(size.tolist(), texts, np.where(size > 0, used, 0).tolist())]


def likeness(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of agreeing places of two embeddings, row by row: each level's samples count for the level's places."""
    n = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, n - x.shape[1])), constant_values=255) for x in (a, b))
    longest = np.maximum(size_a, size_b)
    agree, weights = np.zeros(len(a)), np.zeros(len(a))
    at = 0
    for level, places in enumerate(PLACES):
        if at >= n:
            break
        x, y = a[:, at : at + len(places)], b[:, at : at + len(places)]
        counted = (x != 255) | (y != 255)
        same = ((x == y) & counted).sum(1)
        total = counted.sum(1)
        low = 0 if level == 0 else FIRST << (level - 1)
        weight = np.where(total > 0, np.minimum(longest, FIRST << level) - low, 0)
        share = same / np.maximum(total, 1)
        if level:
            share = np.maximum(0, (share - 1 / 16) * 16 / 15)  # different characters have the same bits in one of 16 cases
        agree += weight * share
        weights += weight
        at += len(places)
    return np.where(weights > 0, agree / np.maximum(weights, 1), 1.0)


def parse(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and samples from fingerprint strings."""
    size = np.array([int(p[:10], 16) for p in prints], np.int64)
    width = max((len(p) - 10 for p in prints), default=0)
    out = np.full((len(prints), width), 255, np.uint8)
    for i, p in enumerate(prints):
        v = np.frombuffer(p[10:].encode(), np.uint8)
        out[i, : len(v)] = np.where(v > 57, v - 87, v - 48)
    out[ALL_PLACES[:width] >= size[:, None]] = 255
    return size, out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 23):
            data, offsets = text_buffers(batch.column("text"))
            codes, at, _ = code_points(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(to_strings(*sketches(codes, at)), pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each text's offsets into them, and each code point's byte offset (and the end)."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return codes, np.searchsorted(places, offsets), places


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"


def compare_with_edited(docs: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """Each row's fingerprint, that of its edited text (second half replaced by the next document's start) and their likeness.

    Rows are dealt into ranges of doc_id and sorted there; the first row of the next range comes along as a guest, so
    no order over all rows is needed. The texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    ids = docs.select("doc_id")
    bounds = range_ids(ids, "doc_id", rows_per_range)
    lowest = int(np.iinfo(np.int64).min)
    top = ids.agg(F.max("doc_id").alias("m")).first()["m"]
    top = lowest if top is None else top

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = range_numbers(batch.column("doc_id"), bounds)
            keys = batch.column("doc_id").fill_null(lowest).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool)), *batch.columns], ["part", "guest", "doc_id", "text"])
            ends = np.flatnonzero(np.isin(keys, np.array(bounds, np.int64)))
            firsts = np.flatnonzero(keys == top)
            for rows, to in ((ends, part[ends] + 1), (firsts, np.zeros(len(firsts), np.int32))):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.ones(len(rows), bool)), *batch.take(pa.array(rows)).columns], ["part", "guest", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for block in row_blocks(batches, "text", 1 << 23):
            batch = pa.Table.from_batches([rest, block]).combine_chunks().to_batches()[0] if rest is not None else block
            rest = batch.slice(batch.num_rows - 1)
            part, guest = batch.column("part").to_numpy(), batch.column("guest").to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~guest[:-1])
            if not len(own):
                continue
            data, offsets = text_buffers(batch.column("text"))
            codes, at, places = code_points(data, offsets)
            n = np.diff(at)
            half = n[own] // 2
            taken = np.minimum(half, n[own + 1])
            pairs = np.stack([at[own], at[own + 1]], 1).ravel()
            sizes = np.stack([n[own] - half, taken], 1).ravel()
            edited_at = np.concatenate([[0], np.cumsum(sizes[0::2] + sizes[1::2])])
            view, digests = memoryview(data.tobytes()), []
            begin, end = places[pairs].tolist(), places[pairs + sizes].tolist()
            for k in range(0, len(pairs), 2):
                h = hashlib.sha256(view[begin[k] : end[k]])
                h.update(view[begin[k + 1] : end[k + 1]])
                digests.append(h.hexdigest())
            size, samples = sketches(codes, at)
            e_size, e_samples = sketches(codes[spans(pairs, sizes)], edited_at)
            prints = to_strings(size, samples)
            near_edited = likeness(size[own], samples[own], e_size, e_samples)
            near_next = likeness(size[own], samples[own], size[own + 1], samples[own + 1])
            out = [batch.column("doc_id").take(pa.array(own)), pa.array(n[own]), pa.array(digests), pa.array([prints[i] for i in own.tolist()], pa.string()), pa.array(to_strings(e_size, e_samples), pa.string()), pa.array(near_edited), pa.array(near_next)]
            out += [pa.array(shared_bands(samples[own], e_samples)), pa.array(shared_bands(samples[own], samples[own + 1]))]
            assert (part[own] == part[own + 1]).all(), "a range without its guest"
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in OUT.split(", ")])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(deal, "part int, guest boolean, doc_id long, text string").repartition(n, "part")
    return dealt.sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()).mapInArrow(run, OUT)


def shared_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bands of BAND sampled places two rows have in common."""
    n = min(a.shape[1], b.shape[1]) // BAND * BAND
    same = ((a[:, :n] == b[:, :n]) & (a[:, :n] != 255)).reshape(len(a), -1, BAND)
    return same.all(2).sum(1).astype(np.int32)


def band_plan(threshold: float) -> tuple[int, list[np.ndarray], list[bool]]:
    """How many of a text's last levels are banded, each level's band borders, and whether its pairs share a second band.

    Levels below the last four weigh at most an eighth, so two texts of the threshold agree in a share of one of these
    levels' samples; bands are so narrow that the others can't break each of them. Above 0.5, their last levels differ
    by one at most. Bands behind the ends of both texts count as shared, but only as a second band.
    """
    top = 4 if threshold > 0.5 else LEVELS
    least = (threshold - 1 / 8) / (1 - 1 / 8) if top < LEVELS else threshold
    borders, second = [], []
    for level, places in enumerate(PLACES):
        differ = 1 - (least * 15 / 16 + 1 / 16 if level else least)
        width = len(places) if differ <= 1e-9 else min(len(places), max(1, int(np.ceil(1 / differ - 1e-9)) - 1))
        n = -(-len(places) // width)
        borders.append(np.arange(n + 1) * len(places) // n)
        second.append(n >= int(len(places) * differ + 1e-9) + 2)
    return top, borders, second


def level_bands(text: str, level: int, borders: np.ndarray) -> list[str]:
    """The bands of a fingerprint's samples of a level, with dots behind the embedding's end."""
    low = 10 + int(np.searchsorted(LEVEL_OF, level))
    inside = int(np.searchsorted(PLACES[level], int(text[:10], 16)))
    own = text[low : low + inside].ljust(len(PLACES[level]), ".")
    return [own[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]


def bucket_links(prints: list[str], threshold: float) -> tuple[list[int], list[int]]:
    """Links that connect exactly what chains of likeness of the threshold or more connect: each group is followed until it reaches no other member."""
    size, samples = parse(prints)
    outside, links = np.arange(len(prints)), ([], [])
    while len(outside):
        queue, outside = [int(outside[0])], outside[1:]
        while queue and len(outside):
            one, met = queue.pop(), []
            for at in range(0, len(outside), AT_ONCE):
                some = outside[at : at + AT_ONCE]
                row = np.full(len(some), one)
                met.append(likeness(size[row], samples[row], size[some], samples[some]) >= threshold)
            near = np.concatenate(met)
            found = outside[near].tolist()
            links[0].extend([one] * len(found))
            links[1].extend(found)
            queue += found
            outside = outside[~near]
    return links


def near_groups(prints: DataFrame, threshold: float = 0.8, most: int = SPLIT_BUCKET) -> DataFrame:
    """doc_id, group_id (smallest doc_id): classes of texts connected by a likeness of the threshold (above 0) or more.

    Distinct fingerprints are banded so that any two of the threshold share a band. Bands with more than `most` members
    are split by a second band of the level, which such two share as well. What is left is compared whole: small
    buckets by all pairs, others group by group, so alike members cost one comparison each.
    """
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    top, borders, second = band_plan(threshold)
    lows = [0, *(FIRST << (i - 1) for i in range(1, LEVELS))]

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column("fingerprint").to_pylist()):
                used = int(np.searchsorted(lows, int(text[:10], 16), "left"))
                for level in range(max(0, used - top), used):
                    for b, band in enumerate(level_bands(text, level, borders[level])):
                        if band[0] != ".":
                            keys.append(f"{level}:{b}:{band}")
                            rows.append(i)
                if len(keys) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("fingerprint").take(pa.array(rows, pa.int64()))], ["band", "fingerprint"])
                    keys, rows = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("fingerprint").take(pa.array(rows, pa.int64()))], ["band", "fingerprint"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, (key, text) in enumerate(zip(batch.column("band").to_pylist(), batch.column("fingerprint").to_pylist())):
                level, own = map(int, key.split(":")[:2])
                more = [f"{key}:{b}:{band}" for b, band in enumerate(level_bands(text, level, borders[level])) if b != own] if second[level] else [key]
                keys += more
                rows += [i] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("fingerprint").take(pa.array(rows, pa.int64()))], ["band", "fingerprint"])

    def candidates(members: list[str]) -> pa.RecordBatch:
        if len(members) <= SMALL_BUCKET:
            a, b = np.triu_indices(len(members), 1)
        else:
            a, b = bucket_links(members, threshold)
        column = pa.array(members, pa.string())
        return pa.RecordBatch.from_arrays([column.take(pa.array(a, pa.int64())), column.take(pa.array(b, pa.int64()))], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            for band, text in zip(batch.column("band").to_pylist(), batch.column("fingerprint").to_pylist()):
                if band != key:
                    if len(members) > 1:
                        yield candidates(members)
                    key, members = band, []
                members.append(text)
        if len(members) > 1:
            yield candidates(members)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            good = np.flatnonzero(likeness(*parse(a), *parse(b)) >= threshold) if a else []
            yield batch.take(pa.array(good, pa.int64()))

    banded = distinct.select("fingerprint").mapInArrow(bands, "band string, fingerprint string")
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = materialize(banded.join(sizes, "band"), "bands")
    large = found.filter(F.col("n") > most).select("band", "fingerprint").mapInArrow(split, "band string, fingerprint string")
    buckets = found.filter(F.col("n") <= most).select("band", "fingerprint").unionByName(large)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = buckets.repartition(parts, "band").sortWithinPartitions("band", "fingerprint").mapInArrow(meet, "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = pairs.mapInArrow(verify, "a string, b string")
    number = lambda c: links.join(distinct.select(F.col("fingerprint").alias(c), F.col("low").alias(f"{c}_low")), c)
    links = number("a").join(distinct.select(F.col("fingerprint").alias("b"), F.col("low").alias("b_low")), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    groups = components(links)
    return prints.join(distinct, "fingerprint").join(groups, F.col("low") == F.col("node"), "left").select("doc_id", F.coalesce("root", "low").alias("group_id"))
