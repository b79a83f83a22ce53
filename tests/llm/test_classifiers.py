"""Language ID and toxicity: parts against brute force, edge rows, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import langid, queries, toxicity
from skein.llm.common import text_buffers

import pyarrow as pa


def test_trigram_rates():
    texts = ["", "ab", "Abc  d!", None, "ñandú 12 xyz\n\nxyz", "   "]
    data, offsets = text_buffers(pa.array(texts))
    got = langid.trigram_rates(data, offsets)
    for row, text in zip(got, texts):
        folded = (text or "").encode().translate(langid.FOLD)
        kept = bytes(b for i, b in enumerate(folded) if b != 32 or i == 0 or folded[i - 1] != 32)
        grams = Counter(kept[i : i + 3] for i in range(len(kept) - 2))
        want = np.zeros(langid.BUCKETS)
        for gram, n in grams.items():
            code = (gram[0] * 0x9E3779B1 + gram[1] * 0x85EBCA6B + gram[2] * 0xC2B2AE35) % (1 << 32) >> 20
            want[code] += n / sum(grams.values())
        assert np.allclose(row, want, atol=1e-6)


@pytest.mark.parametrize("n", [2, 4, 7, 12, 60])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and (code.min(0) < code.max(0)).all()
    if n > 7:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 8
    signs = code * 2.0 - 1
    model = langid.Model([str(i) for i in range(n)], code, np.eye(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]), np.ones(code.shape[1]) / code.shape[1])
    best, score, near = langid.decode(model, signs)
    assert (best == np.arange(n)).all() and ((score > 0) & (score <= 1)).all() and (n > 7 or n < 4 or not near.any())


def test_language_id(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    model = langid.fit(docs)
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 10}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    for least in (0.0, 0.5):
        want = [r.doc_id or 0 for r in langid.predict(edge, langid.fit(edge.filter(~langid.held_out()))).collect() if r.lang_pred != "und" and r.score >= least]
        left = langid.keep_identified(edge, least)
        assert left.columns == edge.columns and sorted(r.doc_id or 0 for r in left.collect()) == sorted(want)
    assert langid.keep_identified(empty).count() == 0


def test_toxicity_features():
    texts = ["The Idiots, the idiots!", None, "ÉTÉ élan", "x1y"]
    names = pa.array(["=idiots", "^idi", "=été", "^éla", "=x"], pa.large_string())
    got = toxicity.matrix(*text_buffers(pa.array(texts)), names)
    assert got[:, :5].astype(int).tolist() == [[1, 1, 0, 0, 0], [0] * 5, [0, 0, 1, 1, 0], [0, 0, 0, 0, 1]]
    assert np.allclose(got[0, 5:], np.sqrt([0.5, 0.5, 0, 0, 0])) and np.allclose(got[3, 5:], np.sqrt([0, 0, 0, 0, 0.5]))


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    first = (x[:, 0] + rng.normal(size=2000) * 0.1 > 0).astype(float)
    second = ((first > 0) & (x[:, 1] > 0)).astype(float)
    folds, ones = rng.integers(0, toxicity.FOLDS, 2000), np.ones(2000)
    own = [np.array([0, 2, 3]), np.array([1, 2])]
    models = toxicity.train_chain(x, own, np.stack([first, second], 1), ones, folds)
    assert [len(m) for m in models] == [4, 4] and models[1][2] > 0.3
    p = toxicity.score_chain(x, own, models)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.9 and ((p[:, 1] > 0.5) == second).mean() > 0.85
    seen = np.zeros(2000)
    for fold in range(toxicity.FOLDS):
        inside = folds != fold
        seen[~inside] = toxicity.probability(x[~inside][:, own[0]], toxicity.logistic(x[inside][:, own[0]], first[inside], ones[inside]))
    again = toxicity.logistic(np.concatenate([x[:, own[1]], toxicity.logit(seen)[:, None]], 1), second, ones)
    assert np.allclose(again, models[1])


def test_toxicity(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id").collect()
    caught = np.mean([r.toxic for r in rows if r.y == 1])
    wrong = np.mean([r.toxic for r in rows if r.y == 0])
    assert caught > 0.82 and wrong < 0.01
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and not any(r.toxic for r in got)
    left = toxicity.keep_clean(edge, labels)  # no labels of these rows say toxic and clean alike: nothing is learned or dropped
    assert left.columns == edge.columns and left.count() == edge.count()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 1, 0), (9, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(edge, toxicity.fit(edge, odd)).count() == edge.count()
    assert toxicity.score(edge, toxicity.fit(edge, odd.limit(0))).filter("toxic").count() == 0


def toxic_corpus(spark, n=400):
    """Half of the documents have a word that tells."""
    rows = [(k, f"plain words number {k % 17} here {'vilest filth' if k % 2 else 'kind garden'} and more {k % 5}") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("quality", ["0", "1", "cast(null as int)"])
def test_toxicity_is_learned_whatever_the_other_category(spark, quality):
    docs = toxic_corpus(spark)
    labels = docs.selectExpr("doc_id", f"{quality} as quality", "cast(doc_id % 2 as int) as toxic")
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[k] == bool(k % 2) for k in got)


def test_the_sample_is_bounded_and_weighted(spark):
    docs = toxic_corpus(spark, 1000)
    docs = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(5000)).selectExpr("doc_id", "concat(text, ' ', id) as text"))
    labels = spark.range(1000).selectExpr("id as doc_id", "1 as quality", "cast(id % 10 = 7 as int) as toxic")
    sample = toxicity._labelled(docs, labels, toxicity.CATEGORIES, 1, 30, 50).collect()
    assert len(sample) == 80 and sum(r.y[1] for r in sample) == 30
    assert {(r.y[1], round(r.weight, 6)) for r in sample} == {(1, round(100 / 30, 6)), (0, 18.0)}
    want = {r.doc_id for r in labels.filter("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit("sample"))).limit(30).collect()}
    texts = {r.text for r in sample if r.y[1]}
    assert texts == {min(r.text for r in docs.filter(f"doc_id = {k}").collect()) for k in want}


def test_query_equals_the_model_by_hand(spark):
    """op4's rows against features, odds and probabilities computed text by text with plain Python numbers."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op4_toxicity_chain(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count()
    place = {n: i for i, n in enumerate(model.names)}
    for r in docs.collect():
        words = [w.lower() for w in (r.text or "").encode().translate(langid.FOLD).decode().split(" ") if w]
        counts = np.zeros(len(place))
        for w in words:
            for f in [f"={w}", *(f"^{w[:n]}" for n in toxicity.PREFIXES if len(w) > n)]:
                if f in place:
                    counts[place[f]] += 1
        x, odds = [*(counts > 0).astype(float), *np.sqrt(counts / max(1, len(words)))], []
        for own, w in zip(model.own, model.weights):
            z = sum(x[i] * v for i, v in zip(own, w)) + sum(a * v for a, v in zip(odds, w[len(own) :])) + w[-1]
            p = 1 / (1 + np.exp(-min(30, max(-30, z))))
            odds.append(np.log(min(max(p, 1e-4), 1 - 1e-4)) - np.log(1 - min(max(p, 1e-4), 1 - 1e-4)))
        assert abs(got[r.doc_id].score - p) < 1e-6 and got[r.doc_id].toxic == (got[r.doc_id].score >= 0.5)


def test_language_query_by_brute_force(spark):
    """op9's rows from trigram counts, log ratios, margins and losses in plain Python, over the rows that may be learned from."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()

    def rates(text):
        folded = (text or "").encode().translate(langid.FOLD)
        kept = bytes(b for i, b in enumerate(folded) if b != 32 or i == 0 or folded[i - 1] != 32)
        out, n = {}, max(1, len(kept) - 2)
        for i in range(len(kept) - 2):
            code = (kept[i] * 0x9E3779B1 + kept[i + 1] * 0x85EBCA6B + kept[i + 2] * 0xC2B2AE35) % (1 << 32) >> 20
            out[code] = out.get(code, 0) + 1 / n
        return out

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    sums = {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            own = sums.setdefault(r.lang, {})
            for code, v in rates(r.text).items():
                own[code] = own.get(code, 0) + v
    langs = sorted(sums)
    share = {lang: {c: v / sum(sums[lang].values()) for c, v in sums[lang].items()} for lang in langs}
    code = langid.codewords(len(langs))
    bits = []
    for b in range(code.shape[1]):
        sides = [[share[lang] for i, lang in enumerate(langs) if code[i, b] == side] for side in (1, 0)]
        mean = lambda group, c: sum(s.get(c, 0) for s in group) / len(group)
        weight = [min(6, max(-6, np.log((mean(sides[0], c) + 1e-6) / (mean(sides[1], c) + 1e-6)))) for c in range(langid.BUCKETS)]
        expected = [sum(v * weight[c] for c, v in share[lang].items()) for lang in langs]
        low, high = max(e for e, x in zip(expected, code[:, b]) if x == 0), min(e for e, x in zip(expected, code[:, b]) if x == 1)
        bits.append((weight, (low + high) / 2, max((high - low) / 2, 1e-3)))
    total = sum(h for _, _, h in bits)
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        mine = rates(r.text)
        margins = [min(3, max(-3, (sum(v * w[c] for c, v in mine.items()) - centre) / half)) for w, centre, half in bits]
        loss = [sum(np.exp(-m * (2 * int(x) - 1)) * h / total for m, x, (_, _, h) in zip(margins, code[i], bits)) for i in range(len(langs))]
        score = 1 / sum(np.exp(langid.SHARPNESS * (min(loss) - x)) for x in loss)
        lettered = any(ch.isalpha() for ch in r.text or "")
        assert got[r.doc_id].held_out == held[r.doc_id]
        assert got[r.doc_id].lang_pred == (langs[int(np.argmin(loss))] if lettered else "und") and abs(got[r.doc_id].score - (score if lettered else 0)) < 1e-3
