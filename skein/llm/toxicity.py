"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model also sees the probabilities of the categories before
it. While training, those come from models that were fitted without the row's fold. Features are words and their
first letters, as presence and as a share of the text's words; each category has its own, those with the strongest
association with it among those that are more frequent in it.

The classifier is fitted on a bounded sample of labelled documents: at most `most_positive` that have the target
category and `most_negative` others, those with the smallest hashes of their doc_id, weighted back to their shares.
Every row is scored over its whole text, however long.

Defined results: a null text is empty and scores as one without words; labels with null or no documents are not used;
of several labels of a doc_id the largest counts, of several documents with it the one with the smallest text is
learned from; without labelled documents of both kinds nothing is toxic; rows with the same doc_id or text are scored
each, alike; ties at the threshold count as toxic; bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty result; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, row_blocks, strings, text_buffers, valid_text
from skein.llm.langid import FOLD

PREFIXES = (3, 4, 5, 6, 7)
FOLDS = 4
#: Categories in their order, as expressions over labels (quality 0/1, toxic 0/1).
CATEGORIES: tuple[tuple[str, str], ...] = (
    ("low_quality", "quality = 0"),
    ("toxic", "toxic = 1"),
)
TARGET = "toxic"


def _marked(mark: str, values: pa.Array) -> pa.Array:
    empty = pa.scalar("", values.type)
    return pc.binary_join_element_wise(pa.scalar(mark, values.type), values, empty)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """For each kind of feature the distinct words' features (null where too short), each word's place, and the words' bounds by text."""
    folded = data.tobytes().translate(FOLD)
    lists = pc.ascii_split_whitespace(strings(folded, offsets))
    bounds = lists.offsets.to_numpy()
    words = lists.flatten()
    filled = pc.binary_length(words).to_numpy() > 0
    bounds = np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]
    coded = words.filter(pa.array(filled)).dictionary_encode()
    distinct = pc.utf8_lower(coded.dictionary)
    kinds = [_marked("=", distinct)]
    length = pc.utf8_length(distinct)
    for n in PREFIXES:
        cut = _marked("^", pc.utf8_slice_codeunits(distinct, 0, n))
        kinds.append(pc.if_else(pc.greater(length, n), cut, pa.scalar(None, cut.type)))
    return kinds, coded.indices.to_numpy().astype(np.int64), bounds


@dataclass
class Model:
    """own: for each category the places of its features in names; the columns of a matrix are those twice, presence and share."""

    categories: list[str]
    names: list[str]
    own: list[np.ndarray]
    weights: list[np.ndarray]


def matrix(data: np.ndarray, offsets: np.ndarray, names: pa.Array) -> np.ndarray:
    """Presence and share of each named feature in each text."""
    kinds, words, bounds = features(data, offsets)
    n, k = len(offsets) - 1, len(names)
    counts = np.zeros(n * k)
    row = np.repeat(np.arange(n), np.diff(bounds))
    for kind in kinds:
        found = pc.fill_null(pc.index_in(kind, value_set=names, skip_nulls=True), -1).to_numpy()[words]
        there = np.flatnonzero(found >= 0)
        counts += np.bincount(row[there] * k + found[there], minlength=n * k)
    counts = counts.reshape(n, k)
    share = counts / np.maximum(1, np.diff(bounds))[:, None]
    return np.concatenate([counts > 0, np.sqrt(share)], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.2, rounds: int = 12) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last number is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None].astype(x.dtype)).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train_chain(x: np.ndarray, own: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category, over its own columns and the log odds of the categories before it, which are out of fold here."""
    models, before = [], np.zeros((len(x), 0), x.dtype)
    for c, columns in enumerate(own):
        y, seen = labels[:, c], np.concatenate([x[:, columns], before], 1)
        models.append(logistic(seen, y, weight))
        if c == len(own) - 1:
            break  # no later category sees the last one's
        out = np.zeros(len(y))
        for fold in range(FOLDS):
            inside = folds != fold
            if (~inside).any():
                out[~inside] = probability(seen[~inside], logistic(seen[inside], y[inside], weight[inside])) if inside.any() else y.mean()
        before = np.concatenate([before, logit(out)[:, None].astype(x.dtype)], 1)
    return models


def score_chain(x: np.ndarray, own: list[np.ndarray], models: list[np.ndarray]) -> np.ndarray:
    before, out = np.zeros((len(x), 0)), []
    for columns, w in zip(own, models):
        p = probability(np.concatenate([x[:, columns], before], 1), w)
        out.append(p)
        before = np.concatenate([before, logit(p)[:, None]], 1)
    return np.stack(out, 1)


def _labelled(docs: DataFrame, labels: DataFrame, categories, target: int, most_positive: int, most_negative: int) -> DataFrame | None:
    """text, y (array of 0/1 by category), weight, fold: the bounded sample, one row per doc_id."""
    ones: list[Column] = [F.coalesce(F.max(F.expr(e).cast("int")), F.lit(0)) for _, e in categories]
    per_doc = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.array(*ones).alias("y"))
    per_doc = per_doc.withColumn("hit", F.col("y")[target]).withColumn("h", F.xxhash64("_id", F.lit("sample")))
    sizes = {r["hit"]: r["count"] for r in per_doc.groupBy("hit").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    chosen = None
    for hit, most in ((1, most_positive), (0, most_negative)):
        # little more than what is taken passes the hash, so that no task hands on many rows for the last choice
        share = min(1.0, (most + 8 * most**0.5 + 8) / sizes[hit])
        some = per_doc.filter((F.col("hit") == hit) & (F.col("h") <= min((1 << 63) - 1, int(share * 2**64) - (1 << 63)))).orderBy("h", "_id").limit(most).select("_id", "y", F.lit(max(1.0, sizes[hit] / most)).alias("weight"), F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(valid_text(), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most most_positive + most_negative ids
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"), F.first("fold").alias("fold")).drop("_id")


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, target: str = TARGET, most_positive: int = 3000, most_negative: int = 9000, per_category: int = 160) -> Model:
    names = [c for c, _ in categories]
    nothing = Model(names, [], [], [])
    sample = _labelled(docs, labels, categories, names.index(target), most_positive, most_negative)
    if sample is None:
        return nothing
    sample = materialize(sample, "sample")  # the texts are scanned once for it
    width = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 21):
            data, offsets = text_buffers(batch.column("text"))
            y = np.array(batch.column("y").to_pylist(), np.int64).reshape(-1, width)
            kinds, words, bounds = features(data, offsets)
            row = np.repeat(np.arange(len(y)), np.diff(bounds))
            for kind in kinds:
                coded = kind.dictionary_encode()
                of_word = pc.fill_null(coded.indices, -1).to_numpy()[words]
                there = of_word >= 0
                pair = np.unique(row[there] * (len(coded.dictionary) + 1) + of_word[there])
                doc, feature = np.divmod(pair, len(coded.dictionary) + 1)
                m = len(coded.dictionary)
                n = [np.bincount(feature, minlength=m), *(np.bincount(feature, y[doc, c], m).astype(np.int64) for c in range(width))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * (width + 1) + 1, width + 1), pa.int32()), pa.array(np.stack(n, 1).ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), lists], ["feature", "n"])

    totals = sample.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col("y")[c]), F.lit(0)).alias(f"n{c}") for c in range(width))).first()
    hits = totals[f"n{names.index(target)}"]
    if not hits or hits == totals["n"]:
        return nothing  # the labelled documents of one kind are not there
    counted = sample.select("text", "y").mapInArrow(count, "feature string, n array<long>").groupBy("feature").agg(F.sum(F.col("n")[0]).alias("df"), *(F.sum(F.col("n")[c + 1]).alias(f"df{c}") for c in range(width)))
    counted = materialize(counted.filter("df >= 3"), "features")
    chosen: list[list[str]] = []
    for c in range(width):
        # log likelihood ratio of the 2 x 2 table (category, presence)
        cells = [(F.col(f"df{c}"), totals[f"n{c}"]), (F.col("df") - F.col(f"df{c}"), totals["n"] - totals[f"n{c}"])]
        gain = F.lit(0.0)
        for seen, size in cells:
            for k, marginal in ((seen, F.col("df")), (F.lit(size) - seen, F.lit(totals["n"]) - F.col("df"))):
                gain = gain + F.when((k > 0) & (marginal > 0), k * F.log(k * F.lit(float(totals["n"])) / (marginal * F.lit(float(max(size, 1)))))).otherwise(0.0)
        # a feature that tells for the category; what is common outside it would only weigh against the few words that matter
        tells = F.col(f"df{c}") * (totals["n"] - totals[f"n{c}"]) > (F.col("df") - F.col(f"df{c}")) * totals[f"n{c}"]
        best = counted.filter(tells).orderBy(F.desc(gain), "feature").limit(per_category)
        chosen.append([r["feature"] for r in best.select("feature").collect()])
    picked = sorted({f for own in chosen for f in own})
    if not picked:
        return nothing
    places = [np.array([picked.index(f) for f in sorted(own)], np.int64) for own in chosen]
    own = [np.concatenate([p, p + len(picked)]) for p in places]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(picked, pa.large_string())
        for batch in row_blocks(batches, "text", 1 << 21):
            x = matrix(*text_buffers(batch.column("text")), known).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column("y"), batch.column("weight"), batch.column("fold")], ["x", "y", "weight", "fold"])

    rows = sample.mapInArrow(vectors, "x binary, y array<int>, weight double, fold int").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, -1)
    y = np.array(rows.column("y").to_pylist(), float).reshape(-1, width)
    order = np.lexsort((x @ np.cos(np.arange(x.shape[1])), rows.column("fold").to_numpy()))  # the same sums whatever order rows arrive in
    weight = rows.column("weight").to_numpy()
    weight = weight / weight.mean()
    return Model(names, picked, own, train_chain(x[order], own, y[order], weight[order], rows.column("fold").to_numpy()[order]))


def probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """By text and category."""
    if not model.names or not len(column):
        return np.zeros((len(column), len(model.categories)))
    return score_chain(matrix(*text_buffers(column), pa.array(model.names, pa.large_string())), model.own, model.weights)


def score(docs: DataFrame, model: Model, target: str = TARGET, threshold: float = 0.5) -> DataFrame:
    """doc_id, toxic, score, and p_<category> for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred features
    at = model.categories.index(target)
    columns = [f"p_{c}" for c in model.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 21):
            p = probabilities(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[:, at] >= threshold), pa.array(p[:, at]), *(pa.array(v) for v in p.T)], ["doc_id", "toxic", "score", *columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, toxic boolean, score double, " + ", ".join(f"{c} double" for c in columns))


def keep_clean(docs: DataFrame, labels: DataFrame, target: str = TARGET, threshold: float = 0.5) -> DataFrame:
    """docs without toxic rows, all columns kept; nothing is joined."""
    model = fit(docs, labels, target=target)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = model.categories.index(target)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [probabilities(b.column(0), shared.value)[:, at] < threshold for b in row_blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", 1 << 21)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.filter(F.arrow_udf(run, "boolean")(valid_text()))
