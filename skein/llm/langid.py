"""Language ID by error-correcting output codes.

Each language has a codeword; a binary n-gram classifier for each bit tells the languages with a one there from the
others by log ratios of byte-trigram frequencies. A text's bits come out as margins; the language whose codeword has
the least weighted loss against them wins, and a near tie is flagged.

The trigram statistics cover every labelled row: texts' trigram rates are summed per language in the tasks and again
in a shuffle, so a language's model is `buckets` numbers whatever the corpus holds.

Defined results: `und` with score 0 if the text is null, empty or without a letter, or if there is nothing to learn
from; rows with a null lang are not learned from; a null doc_id counts as not held out; rows with the same doc_id or text
are predicted each, alike; of languages that are equally near the first by name counts; very long texts count whole;
bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty result; columns besides doc_id, text and lang,
whatever their names, are not looked at. lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import group_sums, row_blocks, text_buffers, valid_text

BUCKETS = 4096
RATE = 100_000
#: How sharply losses turn into a score.
SHARPNESS = 4.0
AMBIGUOUS = 0.6

#: A-Z to a-z, other ASCII than letters to a space; bytes of other scripts stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def trigram_rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's share of every bucket of byte trigrams; white space counts once between words."""
    n = len(offsets) - 1
    folded = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
    blank = folded == 32
    begins = np.zeros(len(folded), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    keep = ~blank | ~np.concatenate([[True], blank[:-1]]) | begins
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    text = folded[keep].astype(np.uint32)
    if len(text) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    code = (text[:-2] * np.uint32(0x9E3779B1) + text[1:-1] * np.uint32(0x85EBCA6B) + text[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 12)
    sizes = np.maximum(0, np.diff(at) - 2)
    row = np.repeat(np.arange(n), np.diff(at))[: len(code)]
    inside = np.arange(len(code)) + 2 < at[1:][row]
    counts = np.bincount(row[inside] * BUCKETS + code[inside].astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return (counts / np.maximum(1, sizes)[:, None]).astype(np.float32)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = data | 32
    ascii_letters = group_sums(((lower >= 97) & (lower <= 122) & (data < 128)).astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~ascii_letters).tolist():
        ascii_letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")))
    return ascii_letters


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language: all splits for up to seven, else the best of random codes by least distance."""
    if languages < 2:
        return np.zeros((languages, 1), np.int8)
    if languages <= 7:
        columns = np.arange(1, 1 << (languages - 1))
        return np.stack([columns >> i & 1 for i in range(languages)]).astype(np.int8)
    bits, rng = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(languages)
    best, widest = None, -1
    for _ in range(60):
        code = rng.integers(0, 2, (languages, bits)).astype(np.int8)
        if (code.min(0) == code.max(0)).any():
            continue
        signs = code.astype(np.int32) * 2 - 1
        distance = (bits - signs @ signs.T) // 2 + np.eye(languages, dtype=np.int32) * bits
        if distance.min() > widest:
            best, widest = code, int(distance.min())
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    half: np.ndarray
    bit_weight: np.ndarray


def fit(docs: DataFrame, most_languages: int = 1000) -> Model:
    """Learns from all rows of docs (text, lang) whose lang is one of the most_languages most frequent ones (by name among equals).

    So the model is at most most_languages x BUCKETS numbers, whatever a dirty column holds; there are fewer written languages with corpora.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in row_blocks(batches, "text", 1 << 20):
            langs = np.array(batch.column("lang").to_pylist())
            for at in range(0, batch.num_rows, 512):
                data, offsets = text_buffers(batch.column("text").slice(at, 512))
                rates = trigram_rates(data, offsets)
                for lang in np.unique(langs[at : at + 512]).tolist():
                    some = np.rint(rates[langs[at : at + 512] == lang] * RATE).astype(np.int64).sum(0)
                    sums[lang] = sums.get(lang, 0) + some
        for lang, total in sums.items():
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(total[there])], ["lang", "bucket", "n"])

    known = docs.select(valid_text().alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    if known.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        frequent = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
        known = known.join(F.broadcast(frequent.select("lang")), "lang", "left_semi").select("text", "lang")
    totals = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = totals.column("lang").to_numpy(zero_copy_only=False)
    languages = sorted(set(names.tolist()))
    share = np.zeros((len(languages), BUCKETS))
    share[np.searchsorted(languages, names) if languages else [], totals.column("bucket").to_numpy()] = totals.column("n").to_numpy()
    return from_shares(languages, share)


def from_shares(languages: list[str], share: np.ndarray) -> Model:
    code = codewords(len(languages))
    share = share / np.maximum(1, share.sum(1, keepdims=True))
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits))
    centre, half = np.zeros(bits), np.ones(bits)
    smooth = 1e-6
    for b in range(bits if len(languages) > 1 else 0):
        one, zero = share[code[:, b] == 1].mean(0), share[code[:, b] == 0].mean(0)
        weights[:, b] = np.clip(np.log((one + smooth) / (zero + smooth)), -6, 6)
        expected = share @ weights[:, b]
        low, high = expected[code[:, b] == 0].max(), expected[code[:, b] == 1].min()
        centre[b], half[b] = (low + high) / 2, max((high - low) / 2, 1e-3)
    return Model(languages, code, weights.astype(np.float32), centre, half, half / half.sum())


def decode(model: Model, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each row's best language, its score, and whether the second is near."""
    signs = model.code.astype(float) * 2 - 1
    margins = np.clip((rates @ model.weights - model.centre) / model.half, -3, 3)
    loss = np.exp(-margins[:, None, :] * signs[None]) @ model.bit_weight
    best = loss.argmin(1)
    odds = np.exp(SHARPNESS * (loss.min(1, keepdims=True) - loss))
    score = 1 / odds.sum(1)
    return best, score, score < AMBIGUOUS


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(["und", *model.languages], object)
        for block in row_blocks(batches, "text", 1 << 20):
            for at in range(0, block.num_rows, 512):
                batch = block.slice(at, 512)
                data, offsets = text_buffers(batch.column("text"))
                place, score, near = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                if model.languages:
                    lettered = has_letter(data, offsets)
                    best, sure, unsure = decode(model, trigram_rates(data, offsets))
                    place, score, near = np.where(lettered, best + 1, 0), np.where(lettered, sure, 0.0), unsure | ~lettered
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[place], pa.string()), pa.array(score), pa.array(near)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), valid_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    return predict(docs, fit(docs.filter(~held_out())))


def keep_identified(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """docs without the rows whose language is undetermined or whose best language scores under least_score, all columns kept.

    The decision is taken row by row beside the columns, so nothing is joined.
    """
    model = fit(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = []
            for block in row_blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", 1 << 20):
                for at in range(0, block.num_rows, 512):
                    data, offsets = text_buffers(block.column("text").slice(at, 512))
                    keep = np.zeros(len(offsets) - 1, bool)
                    if shared.value.languages:
                        keep = has_letter(data, offsets) & (decode(shared.value, trigram_rates(data, offsets))[1] >= least_score)
                    parts.append(keep)
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.filter(F.arrow_udf(run, "boolean")(valid_text()))
