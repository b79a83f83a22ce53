"""The language model against brute force: counts, normalisation, held-out gain, edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from skein.llm import maxent_lm as lm
from skein.llm.common import LOWER_TABLE


def tokens_of(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER_TABLE))]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def mixed(*parts):
    """The row of weights that a feature hits, by whole numbers modulo 2^64."""
    key, kind, node, bits = parts
    a, b, c = map(int, lm.MIX)
    return (((key * lm.FEATURES + kind) * a ^ (node + 1) * b) % 2**64 * c % 2**64) >> (64 - bits)


def leaf_log10(model, leaf, one, two):
    """log10 of a leaf's probability after the leaves one and two before it, decision by decision."""
    tree, bits = model.tree, len(model.weights).bit_length() - 1
    keys = (one, two, int(tree.group[one]) * (lm.RADIX**2 + 1) + int(tree.group[two]))
    out = 0.0
    for k, at in enumerate(range(tree.starts[leaf], tree.starts[leaf + 1])):
        node = int(tree.nodes[at])
        logits = tree.bias[node].astype(float) + sum(model.weights[mixed(key, kind, node, bits)].astype(float) for kind, key in enumerate(keys[: 3 if k < lm.EARLY else 2]))
        out += (logits[tree.digits[at]] - math.log(np.exp(logits).sum())) / math.log(10)
    return out


def brute(rows, model):
    """Base and model scores word by word, given the fitted classes and weights; counts are our own."""
    counts, ends = Counter(), 0
    for doc_id, text in rows:
        if not held(doc_id):
            counts.update(tokens_of(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    head = {w: lm.FIRST_WORD + i for i, w in enumerate(model.head.to_pylist())}
    every = sorted({w for _, t in rows for w in tokens_of(t)})
    rest_of = dict(zip(every, lm.rests(pa.array(every, pa.large_string()), model.endings).tolist()))
    mass, types = Counter(), Counter()
    for w, k in counts.items():
        if w not in head:
            mass[rest_of[w]] += k
            types[rest_of[w]] += 1
    start, out = len(model.tree.starts) - 1, []
    for doc_id, text in rows:
        words = tokens_of(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        score, one, two = 0.0, start, start
        for w in [*words, None]:
            leaf = lm.END if w is None else head.get(w, rest_of[w])
            score += leaf_log10(model, leaf, one, two)
            if w is not None and w not in head:
                score += math.log10((counts[w] + 0.5) / (mass[leaf] + 0.5 * (types[leaf] + 1)))
            two, one = one, leaf
        out.append((doc_id, held(doc_id), len(words) + 1, sum(w in counts for w in words) + (ends > 0), n, base, score))
    return out


def compare(table, rows, **options):
    model, tail = lm.fit(table.filter(~lm.held_out()), **options)
    got = lm.score(table, model, tail).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows, model), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9) and np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-4)
    return got


def test_scores_equal_brute_force(spark, edge):
    small = edge.filter("doc_id is null or doc_id not in (6, 7, 12)")
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    compare(small, rows)
    compare(small, rows, most_head=2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 900")
    compare(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], most_head=100)


def test_very_long_texts(spark, edge):
    """Texts of many batches, against one walk over all tokens at once."""
    long = edge.filter("doc_id in (6, 7)")
    model, tail = lm.fit(long, most_head=500)
    small, lm.BATCH_TOKENS = lm.BATCH_TOKENS, 1 << 20
    try:
        got = {r.doc_id: r.score for r in lm.score(long, model, tail).collect()}
        counts = {r.token: r.n for r in tail.collect()}
        log_rest = np.log10(model.rest_mass + 0.5 * (model.rest_types + 1))
        for r in long.collect():
            data = np.frombuffer(r.text.encode(), np.uint8)
            distinct, places, bounds = lm.words(data, np.array([0, len(data)]))
            leaves, head = model.leaves(distinct)
            tokens, at = lm.sequences(leaves[places], bounds)
            alone = np.array([0.0 if h >= 0 else math.log10(counts.get(w, 0) + 0.5) - log_rest[leaf] for w, h, leaf in zip(distinct.to_pylist(), head, leaves)])
            want = lm.log_probabilities(model.tree, model.weights, tokens, at).sum() + alone[places].sum()
            assert abs(got[r.doc_id] - want) < 1e-5 * abs(want)
    finally:
        lm.BATCH_TOKENS = small


def test_every_training_row_is_walked_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, _ = lm.fit(docs)
    assert sum(n for n, _ in model.progress) == model.train_tokens and len(model.progress) == len(lm.ROUNDS) - 1


def test_model_is_normalised_and_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, tail = lm.fit(docs.filter(~lm.held_out()))
    leaves = len(model.tree.starts) - 1
    for one, two in ((leaves, leaves), (lm.FIRST_WORD, lm.FIRST_WORD + 3), (lm.FIRST_WORD + 40, 2)):
        p = [leaf_log10(model, leaf, one, two) for leaf in range(leaves)] if leaves < 3000 else None
        every = np.arange(leaves)
        f = lm.factors(model.tree, model.weights, every, np.full(leaves, one), np.full(leaves, two))
        logs = np.bincount(f.token, np.log10(f.odds[np.arange(len(f.digit)), f.digit] / f.total), leaves)
        assert abs((10**logs).sum() - 1) < 1e-3 and (p is None or np.allclose(p, logs, atol=1e-3))
    rows = [r for r in lm.score(docs, model, tail).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    print("held-out gain per token, log10:", gain)
    assert gain > 0.1 and all(r.score < 0 for r in rows)


def test_weights_move_along_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(0)
    n = 300
    tree = lm.build_tree(rng.permutation(n), rng.random(n) + 0.01)
    tokens, at = rng.integers(0, n, 60), np.array([0, 25, 60])
    weights = rng.normal(size=(64, lm.RADIX)).astype(np.float32) * 0.1
    moved, met = weights.copy(), np.zeros(64, np.float32)
    lm.walk(tree, moved, met, tokens, at, 1e-3)
    decisions = np.diff(tree.starts)[tokens]
    assert met.sum() == 2 * decisions.sum() + np.minimum(decisions, lm.EARLY).sum()
    likelihood = lambda w: lm.log_probabilities(tree, w, tokens, at).sum() * math.log(10)
    # with few rows each is hit by every kind of feature, so its moves are sums with steps of one sign along the gradient
    gradient = np.zeros((64, 3))
    for row in range(64):
        for c in range(3):
            up, down = weights.astype(float), weights.astype(float)
            up[row, c] += 1e-3
            down[row, c] -= 1e-3
            gradient[row, c] = (likelihood(up) - likelihood(down)) / 2e-3
    way = (moved - weights)[:, :3]
    assert np.corrcoef(way.ravel(), gradient.ravel())[0, 1] > 0.8 and likelihood(moved) > likelihood(weights)


def test_nothing_to_learn_from(edge, empty):
    assert lm.score_corpus(empty).count() == 0
    only_held = edge.filter(lm.held_out())
    rows = lm.score_corpus(only_held).collect()
    assert len(rows) == only_held.count() and all(r.train_tokens == 0 and r.score == 0 and abs(r.base_score) < 1e-6 for r in rows)
