"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) is a product of softmaxes over nested classes. The most frequent words (a bounded list), the end of a
text and one rest per kind of ending are leaves, in the order of their spelling from behind. They are cut into RADIX
classes of near-equal mass, each of those again, until every leaf is alone, so each factor's normaliser is RADIX wide. A
factor's logits are its classes' log shares plus the weights that its hashed features hit: the word before (n-gram), the
word before that (skip), and in the first decisions the classes of both. The number of weights grows with the training tokens, up
to a bound. Words that are no leaf share their ending's rest in proportion to their smoothed counts; each rest keeps one
place for words that were not in training.

What is learned comes from all training rows: word counts by a shuffle that grows with the vocabulary, and weights by
rounds of gradient updates. The rounds take disjoint, growing parts of the rows, so every training row is used once. A
round's tasks walk over their rows in small batches from the broadcast weights on; their moves are averaged feature by
feature, weighted by how often each task met it. Counts of the frequent words are broadcast with the weights; all others
reach their documents by a join.

Defined results: a null text is empty and has the end token only; a row with a null doc_id is in training; rows with
the same doc_id and text count as often as they are there; very long texts are walked in batches like others; bytes that
are no UTF-8 count as U+FFFD; of equally frequent words at the head's border none is in it; without
training rows all scores are 0; an empty table gives an empty result; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LOWER_TABLE, materialize, release_memory, row_blocks, spans, strings, text_buffers, valid_text

RADIX = 8
#: Leaves: the end of a text, the rests of this many endings and of three kinds of others, then words.
END, ENDINGS = 0, 60
RESTS = ENDINGS + 3
FIRST_WORD = 1 + RESTS
FEATURES = 3
#: The classes of the two words before count for so many of a word's first decisions.
EARLY = 2
#: Weights are kept and summed in blocks of this many rows of RADIX.
BLOCK_ROWS = 4096
#: Rounds take the rows whose hash modulo the last of these lies between one and the next.
ROUNDS = (0, 1, 4, 16)
BATCH_TOKENS = 1 << 12
#: Odds are kept from running over; weights come nowhere near it.
MOST_LOGIT = np.float32(40)
SIGNS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
BLOCK_BYTES = 6 << 20
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and the words' bounds by text."""
    lists = pc.ascii_split_whitespace(strings(data.tobytes().translate(LOWER_TABLE), offsets))
    bounds = lists.offsets.to_numpy()
    found = lists.flatten()
    filled = pc.binary_length(found).to_numpy() > 0
    bounds = np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]
    coded = found.filter(pa.array(filled)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds


def endings(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The last two characters before closing signs, marked with the kind of those signs (0: none, 1: comma or stop, 2: others)."""
    core = pc.ascii_rtrim(distinct, characters=SIGNS)
    long, short = pc.binary_length(distinct).to_numpy(), pc.binary_length(core).to_numpy()
    last = pc.utf8_slice_codeunits(distinct, -1)
    stop = pc.is_in(last, value_set=pa.array([",", "."], last.type)).to_numpy(zero_copy_only=False)
    kind = np.where(long == short, 0, np.where((long == short + 1) & stop, 1, 2))
    core = pc.if_else(pa.array(short > 0), core, distinct)
    marks = pa.array(["0", "1", "2"], core.type).take(pa.array(kind))
    return pc.binary_join_element_wise(marks, pc.utf8_slice_codeunits(core, -2), pa.scalar("", core.type)), kind


def rests(distinct: pa.Array, known: list[str]) -> np.ndarray:
    """The leaf of the rest that each word would belong to."""
    ending, kind = endings(distinct)
    at = pc.fill_null(pc.index_in(ending, value_set=pa.array(known, ending.type)), -1).to_numpy()
    return np.where(at >= 0, 1 + at, 1 + ENDINGS + kind).astype(np.int64)


@dataclass
class Tree:
    """For leaf i its decisions: nodes[starts[i]:starts[i+1]] and the class taken in each; bias[node, class]: log shares; group: the first two classes."""

    starts: np.ndarray
    nodes: np.ndarray
    digits: np.ndarray
    bias: np.ndarray
    group: np.ndarray


def build_tree(order: np.ndarray, mass: np.ndarray) -> Tree:
    """Cuts the leaves, in the given order, into RADIX runs of near-equal mass, and each run again."""
    n = len(order)
    total = np.concatenate([[0.0], np.cumsum(mass[order])])
    levels, bias, todo = [], [], [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= RADIX:
            cuts = np.arange(lo, hi + 1)
        else:
            goals = total[lo] + (total[hi] - total[lo]) * np.arange(1, RADIX) / RADIX
            cuts = np.unique(np.concatenate([[lo], np.clip(np.searchsorted(total, goals, "right"), lo + 1, hi - 1), [hi]]))
        if depth == len(levels):
            levels.append((np.full(n, -1, np.int64), np.zeros(n, np.uint8)))
        node, digit = levels[depth]
        node[lo:hi] = len(bias)
        digit[lo:hi] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        shares = np.full(RADIX, -30.0, np.float32)
        shares[: len(cuts) - 1] = np.log(np.diff(total[cuts]) / (total[hi] - total[lo]))
        bias.append(shares)
        todo += [(a, b, depth + 1) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
    nodes, digits = np.stack([x for x, _ in levels], 1), np.stack([x for _, x in levels], 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    nodes, digits = nodes[place], digits[place]
    used = nodes >= 0
    second = digits[:, 1].astype(np.int64) if digits.shape[1] > 1 else 0
    group = np.append(digits[:, 0].astype(np.int64) * RADIX + second, RADIX * RADIX)  # the last is the place before a text
    return Tree(np.concatenate([[0], np.cumsum(used.sum(1))]), nodes[used].astype(np.int32), digits[used], np.array(bias, np.float32).reshape(-1, RADIX), group)


def sequences(word_leaves: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of all tokens with each text's end token, and the texts' bounds."""
    at = bounds + np.arange(len(bounds))
    out = np.full(int(at[-1]), END, np.int64)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = word_leaves
    return out, at


def contexts(tokens: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves one and two before each token; start stands for the place before a text."""
    one, two = np.concatenate([[start], tokens[:-1]]), np.concatenate([[start, start], tokens[:-2]])[: len(tokens)]
    one[at[:-1]] = start
    two[at[:-1]] = start
    second = at[:-1] + 1
    two[second[second < at[1:]]] = start
    return one, two


def hashes(one: np.ndarray, two: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By feature and token: the word before, the word two before (skip), the classes of both."""
    keys = (one, two, group[one] * (RADIX * RADIX + 1) + group[two])
    return np.stack([(k.astype(np.uint64) * np.uint64(FEATURES) + np.uint64(i)) * MIX[0] for i, k in enumerate(keys)])


@dataclass
class Factors:
    """The decisions that make up some tokens: whose they are, the class taken, all classes' odds and their sums; and the
    features: the rows of weights that they hit, and for which decisions (None: all)."""

    token: np.ndarray
    digit: np.ndarray
    odds: np.ndarray
    total: np.ndarray
    hits: list[tuple[np.ndarray, np.ndarray | None]]


def factors(tree: Tree, weights: np.ndarray, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> Factors:
    first = tree.starts[tokens]
    lengths = tree.starts[tokens + 1] - first
    place = spans(first, lengths)
    token = np.repeat(np.arange(len(tokens)), lengths)
    node = tree.nodes[place]
    shift = np.uint64(64 - (len(weights).bit_length() - 1))
    own = (node.astype(np.uint64) + np.uint64(1)) * MIX[1]
    early = np.flatnonzero(place - np.repeat(first, lengths) < EARLY)
    logits = np.empty((len(node), RADIX), np.float32)  # numpy's own dtype object: add.at is many times slower with an unpickled one
    np.take(tree.bias, node, 0, logits, "clip")
    some, hits = np.empty((len(node), RADIX), weights.dtype), []
    for hashed, which in zip(hashes(one, two, tree.group), (None, None, early)):
        rows = hashed[token if which is None else token[which]]
        rows ^= own if which is None else own[which]
        rows *= MIX[2]
        rows >>= shift
        rows = rows.view(np.int64)
        np.take(weights, rows, 0, some[: len(rows)], "clip")
        if which is None:
            logits += some
        else:
            logits[which] += some[: len(rows)]
        hits.append((rows, which))
    np.minimum(logits, MOST_LOGIT, out=logits)
    np.exp(logits, out=logits)
    return Factors(token, tree.digits[place], logits, logits @ np.ones(RADIX, np.float32), hits)


def walk(tree: Tree, weights: np.ndarray, met: np.ndarray, tokens: np.ndarray, at: np.ndarray, rate: float = 1.0) -> float:
    """Moves the weights along the gradient of the tokens' log likelihood, batch by batch, and counts in `met` how often each row was hit.

    A row's step is the mean of its gradients in the batch, or their sum over its hits so far to the power 3/4 where that
    is less: frequent features settle within a few batches, rare ones move little. Gives the log likelihood that each
    batch had before its move.
    """
    seen, (one, two), flat, wide = 0.0, contexts(tokens, at, len(tree.starts) - 1), weights.reshape(-1), np.arange(RADIX)
    for low in range(0, len(tokens), BATCH_TOKENS):
        some = slice(low, low + BATCH_TOKENS)
        f = factors(tree, weights, tokens[some], one[some], two[some])
        each, gradient = np.arange(len(f.digit)), f.odds
        seen += float(np.log(np.maximum(gradient[each, f.digit] / f.total, 1e-30)).sum())
        gradient *= (-1 / f.total)[:, None]
        gradient[each, f.digit] += 1
        for hit, which in f.hits:
            before = met[hit]
            np.add.at(met, hit, np.float32(1))
            after = met[hit]
            slow = np.sqrt(after + np.float32(16))
            slow *= np.sqrt(slow)
            step = np.float32(rate) / np.maximum(after - before, slow)
            moves = (gradient if which is None else gradient[which]) * step[:, None]
            np.add.at(flat, ((hit * RADIX)[:, None] + wide).reshape(-1), moves.reshape(-1))
    return seen


def log_probabilities(tree: Tree, weights: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 of each token's leaf given its history."""
    out, (one, two) = np.empty(len(tokens)), contexts(tokens, at, len(tree.starts) - 1)
    for low in range(0, len(tokens), BATCH_TOKENS):
        some = slice(low, low + BATCH_TOKENS)
        f = factors(tree, weights, tokens[some], one[some], two[some])
        taken = np.log10(np.maximum(f.odds[np.arange(len(f.digit)), f.digit] / f.total, 1e-30))
        out[some] = np.bincount(f.token, taken, len(tokens[some]))
    return out


@dataclass
class Model:
    head: pa.Array
    head_counts: np.ndarray
    endings: list[str]
    rest_mass: np.ndarray
    rest_types: np.ndarray
    tree: Tree
    weights: np.ndarray
    train_tokens: int
    types: int
    ends: int
    #: By round: tokens, and the mean log10 likelihood of their leaves before each batch's move.
    progress: list[tuple[int, float]]

    def leaves(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's leaf, and its place in the head or -1."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.head), -1).to_numpy()
        return np.where(at >= 0, FIRST_WORD + at, rests(distinct, self.endings)), at


def fit_weights(docs: DataFrame, model: Model, most_rows: int = 1 << 20, tokens_a_row: int = 4, tokens_a_task: int = 1 << 25) -> None:
    """Fits the model's weights on docs (doc_id, text) in ROUNDS; each row of docs is used in one of them."""
    spark = docs.sparkSession
    size = 1 << int(np.clip(int(model.train_tokens // tokens_a_row).bit_length(), 12, most_rows.bit_length() - 1))
    weights = np.zeros((size, RADIX), np.float16)
    block_rows = min(size, BLOCK_ROWS)
    turn = F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS[-1]))
    for low, high in zip(ROUNDS[:-1], ROUNDS[1:]):
        shared = spark.sparkContext.broadcast((model, weights))  # bounded by most_rows and the head
        tokens = model.train_tokens * (high - low) // ROUNDS[-1]
        tasks = max(1, min(spark.sparkContext.defaultParallelism, tokens >> 20), tokens // tokens_a_task)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, start = shared.value
            weights, met, seen, n = start.astype(np.float32), np.zeros(len(start), np.float32), 0.0, 0
            for batch in row_blocks(batches, "text", BLOCK_BYTES):
                distinct, places, bounds = words(*text_buffers(batch.column("text")))
                tokens, at = sequences(model.leaves(distinct)[0][places], bounds)
                seen, n = seen + walk(model.tree, weights, met, tokens, at), n + len(tokens)
            for block in range(len(weights) // block_rows) if n else ():
                some = slice(block * block_rows, (block + 1) * block_rows)
                moved = (weights[some] - start[some]).astype("<f2")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([moved.tobytes()]), pa.array([met[some].tobytes()]), pa.array([seen if not block else 0.0]), pa.array([n if not block else 0])], ["block", "moved", "met", "seen", "n"])
            release_memory()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, moved, met, seen, n in zip(*(c.to_pylist() for c in batch.columns)):
                    one = sums.setdefault(block, [np.zeros((block_rows, RADIX), np.float32), np.zeros(block_rows, np.float32), 0.0, 0])
                    hits = np.frombuffer(met, np.float32)
                    one[0] += np.frombuffer(moved, "<f2").reshape(-1, RADIX) * hits[:, None]
                    one[1] += hits
                    one[2] += seen
                    one[3] += n
            for block, (moved, met, seen, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(moved / np.maximum(met, 1)[:, None]).astype("<f2").tobytes()]), pa.array([seen]), pa.array([n])], ["block", "moved", "seen", "n"])

        mine = docs.filter((turn >= low) & (turn < high)).select("text").coalesce(tasks)
        moves = mine.mapInArrow(run, "block int, moved binary, met binary, seen double, n long").repartition(min(size // block_rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
        parts = moves.mapInArrow(merge, "block int, moved binary, seen double, n long").toArrow()  # as many numbers as weights
        moved = weights.reshape(-1, block_rows, RADIX).astype(np.float32)
        for block, move in zip(parts.column("block").to_pylist(), parts.column("moved").to_pylist()):
            moved[block] += np.frombuffer(move, "<f2").reshape(block_rows, RADIX)
        weights = moved.reshape(size, RADIX).astype(np.float16)
        n = pc.sum(parts.column("n")).as_py() or 0
        model.progress.append((n, (pc.sum(parts.column("seen")).as_py() or 0.0) / max(n, 1) / np.log(10)))
        shared.destroy()
    model.weights = weights


def fit(docs: DataFrame, most_head: int = 1 << 18, **options) -> tuple[Model, DataFrame]:
    """The model, and the counts (token, n) of the words that are not in its head."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", BLOCK_BYTES):
            distinct, places, _ = words(*text_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(places, minlength=len(distinct)).astype(np.int64))], ["token", "n"])

    counts = materialize(docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    ends = docs.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("types")).first()

    # the smallest count that leaves at most most_head words at or above it
    above, least = 0, 1
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(most_head + 1).collect():
        if above + r["k"] > most_head:
            least = r["n"] + 1
            break
        above += r["k"]
    head = counts.filter(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    tail = counts.filter(F.col("n") < least)

    def by_ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = endings(batch.column("token"))[0].dictionary_encode()
            mass = np.bincount(coded.indices.to_numpy(), batch.column("n").to_numpy(), len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(mass.astype(np.int64))], ["ending", "n"])

    best = tail.mapInArrow(by_ending, "ending string, n long").groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(ENDINGS)
    known = [r["ending"] for r in best.collect()]

    def by_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = rests(batch.column("token"), known)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FIRST_WORD)), pa.array(np.bincount(leaf, batch.column("n").to_numpy(), FIRST_WORD).astype(np.int64)), pa.array(np.bincount(leaf, minlength=FIRST_WORD).astype(np.int64))], ["leaf", "n", "types"])

    mass, types = np.zeros(FIRST_WORD), np.zeros(FIRST_WORD)
    for r in tail.mapInArrow(by_rest, "leaf long, n long, types long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        mass[r["leaf"]], types[r["leaf"]] = r["n"], r["types"]
    names = pa.concat_arrays([pa.array([""] + [e[1:] for e in known] + [""] * (RESTS - len(known)), pa.large_string()), head.column("token").combine_chunks().cast(pa.large_string())])
    leaf_mass = np.concatenate([mass + 0.5 * (types + 1), head.column("n").to_numpy().astype(float)])
    leaf_mass[END] = ends + 0.5
    tree = build_tree(pc.sort_indices(pa.table({"r": pc.utf8_reverse(names), "i": np.arange(len(names))}), [("r", "ascending"), ("i", "ascending")]).to_numpy().astype(np.int64), leaf_mass)
    model = Model(names[FIRST_WORD:], leaf_mass[FIRST_WORD:], known, mass, types, tree, np.zeros((1, RADIX), np.float16), int(totals["n"]) + ends, int(totals["types"]) + (ends > 0), ends, [])
    if ends:
        fit_weights(docs, model, **options)
    return model, tail


ROW = "doc_id long, held_out boolean, h long, token string, times long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: weights and at most most_head words
    base_size = float(np.log10(model.train_tokens + 0.5 * (model.types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.weights.astype(np.float32)
        log_rest = np.log10(model.rest_mass + 0.5 * (model.rest_types + 1))
        log_head = np.log10(np.append(model.head_counts, 0) + 0.5)
        names = [c.split()[0] for c in ROW.split(", ")]
        sums = lambda values, bounds: np.diff(np.concatenate([[0.0], np.cumsum(values)])[bounds])
        for batch in row_blocks(batches, "text", BLOCK_BYTES):
            data, offsets = text_buffers(batch.column("text"))
            distinct, places, bounds = words(data, offsets)
            leaves, at_head = model.leaves(distinct)
            known = at_head >= 0
            tokens, at = sequences(leaves[places], bounds)
            n = np.diff(at)
            n_known = sums(known[places].astype(float), bounds).astype(np.int64) + (model.ends > 0)
            base = sums(np.where(known, log_head[at_head], 0.0)[places], bounds) + np.log10(model.ends + 0.5) - n * base_size
            if model.train_tokens:
                total = sums(log_probabilities(model.tree, weights, tokens, at), at) - sums(np.where(known, 0.0, log_rest[leaves * ~known])[places], bounds)
            else:
                total = np.zeros(len(n))
            raw = data.tobytes()
            view = memoryview(raw)
            h = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64).view(np.int64)
            ids, outs = batch.column("doc_id"), batch.column("held_out")
            zeros = np.zeros(len(n), np.int64)
            # a head row's token joins with nothing and is its own, so that head rows spread over the shuffle
            own = pa.array([f"\n{x}" for x in h.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([ids, outs, pa.array(h), own, pa.array(zeros), pa.array(n), pa.array(n_known), pa.array(base), pa.array(total)], names)
            rare = np.flatnonzero(~known[places])
            row = np.searchsorted(bounds, rare, "right") - 1
            pair, times = np.unique(row * max(1, len(distinct)) + places[rare], return_counts=True)
            row, place = np.divmod(pair, max(1, len(distinct)))
            zeros, nothing = np.zeros(len(row), np.int64), np.zeros(len(row))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), outs.take(pa.array(row)), pa.array(h[row]), distinct.take(pa.array(place)).cast(pa.string()), pa.array(times.astype(np.int64)), pa.array(zeros), pa.array(zeros), pa.array(nothing), pa.array(nothing)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), valid_text().alias("text")).mapInArrow(run, ROW)
    joined = rows.join(tail, "token", "left")
    logged = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    with_model = logged if model.train_tokens else F.lit(0.0)
    sums = joined.groupBy("doc_id", "held_out", "h").agg(
        F.sum((F.col("times") == 0).cast("int")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + logged).alias("base"),
        F.sum(F.col("score") + with_model).alias("score"),
    )
    each = lambda c, kind: (F.col(c) / F.col("copies")).cast(kind).alias(c if c != "base" else "base_score")
    return sums.select("doc_id", "held_out", each("n_tokens", "long"), each("n_known", "long"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), each("base", "double"), each("score", "double"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns from the rows that are not held out."""
    return score(docs, *fit(docs.filter(~held_out())))
