"""Edit embedding and its fingerprints against brute force."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from skein.llm import edit_fingerprint as ef


def slow_sketch(text):
    """The embedding written out place by place, then sampled."""
    classes = ef.char_classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()
    stay = ef.STAY.reshape(ef.CLASSES, ef.PERIOD)
    out, j = [], 0
    for c in classes:
        k = int(stay[c, j % ef.PERIOD])
        out += [c] * k
        j += k
    return j, [int(ef.BITS[out[p], s % 64]) if p < j else 255 for s, p in enumerate(ef.ALL_PLACES[:400])]


def test_walk_and_samples(monkeypatch):
    texts = ["", "a", "hello world", "ñandú " * 50, "x" * 3000, "The quick brown fox. " * 400, "b"]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for few in (48, 0, 2):
        monkeypatch.setattr(ef, "FEW", few)
        size, samples = ef.sketches(codes, offsets)
        for k, text in enumerate(texts):
            j, want = slow_sketch(text)
            width = min(400, samples.shape[1])
            assert size[k] == j and samples[k, :width].tolist() == want[:width]
    prints = ef.to_strings(size, samples)
    again_size, again = ef.parse(prints)
    assert (again_size == size).all() and (again == samples[:, : again.shape[1]]).all() and (samples[:, again.shape[1] :] == 255).all()


def test_go_on_bits_agree_with_stays():
    stay = ef.STAY.reshape(ef.CLASSES, ef.PERIOD)
    assert stay.min() == 1 and stay.max() < 256
    longer = stay > 1
    assert (stay[longer] == np.roll(stay, -1, 1)[longer] + 1).all()


def test_compare_with_edited(edge, docs):
    for table, size in ((edge, 3), (docs, 4096), (docs, 17), (docs.limit(1), 10)):
        table = table.cache()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.text is None) for r in table.select("doc_id", "text").collect()), key=lambda r: (-r[0], -r[1], not r[3], r[2].encode()))
        want = []
        for k, (_, doc_id, text, _) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][2], len(text) // 2
            want.append((rows[k][0] and doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
        got = ef.compare_with_edited(table, rows_per_range=size).collect()
        assert sorted((r.doc_id is not None and r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
        by_text = {}
        texts = {r.doc_id: r.text for r in table.collect()}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.doc_id != 9:
                assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert ef.compare_with_edited(table.limit(0)).count() == 0


def test_likeness_tells_edited_from_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ef.compare_with_edited(docs).collect() if r.n_chars > 100]
    edited, other = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    assert (edited > other).mean() > 0.97 and 0.35 < np.median(edited) < 0.65 and np.median(other) < 0.15


def test_few_edits_stay_alike_and_group(spark):
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 1500").limit(12).collect()]
    rows = []
    for k, text in enumerate(base):
        rows.append((10 * k, text))
        rows.append((10 * k + 1, text[:700] + "x" + text[700:1200] + text[1203:]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.group_id for r in ef.near_groups(ef.fingerprints(frame), 0.6).collect()}
    assert len(groups) == len(rows) and sum(groups[10 * k] == groups[10 * k + 1] for k in range(len(base))) >= len(base) - 2
    assert ef.near_groups(ef.fingerprints(frame.filter(F.lit(False)))).count() == 0


def brute_groups(prints, threshold):
    """The smallest doc_id that chains of likeness reach, from all pairs."""
    size, samples = ef.parse([p for _, p in prints])
    a, b = np.triu_indices(len(prints), 1)
    near = np.concatenate([ef.likeness(size[x], samples[x], size[y], samples[y]) >= threshold for x, y in zip(np.array_split(a, 20), np.array_split(b, 20))])
    root = np.array([d for d, _ in prints])
    while True:
        old = root.copy()
        for x, y in zip(a[near], b[near]):
            root[x] = root[y] = min(root[x], root[y])
        if (old == root).all():
            return dict(zip((d for d, _ in prints), root.tolist())), int(near.sum())


def test_near_groups_lose_no_link(spark):
    rng = np.random.default_rng(7)
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 60").orderBy("doc_id").limit(60).collect()]
    for k, text in enumerate(rows[:40]):
        text, head = text[:1200], rows[k % 3][:200]
        for edits in (1, 2, 4, 7, 11, 16):
            letters = list(text)
            for at in rng.integers(0, len(letters), edits):
                letters[at] = chr(97 + int(rng.integers(0, 26)))
            rows += ["".join(letters), head + "".join(letters)[: 40 + 60 * edits]]
    rows += [f"{w} {n}" for w in ("ab", "the cat sat", "of the people by the people") for n in range(30)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    prints = ef.fingerprints(frame).cache()
    own = sorted((r.doc_id, r.fingerprint) for r in prints.collect())
    for threshold in (0.8, 0.6, 0.95):
        want, links = brute_groups(own, threshold)
        assert links > 100
        for most in (ef.SPLIT_BUCKET, 4):
            assert {r.doc_id: r.group_id for r in ef.near_groups(prints, threshold, most).collect()} == want
    for threshold in (0.8, 0.3):
        a = [p for _, p in own]
        root = list(range(len(a)))
        for x, y in zip(*ef.bucket_links(a, threshold)):
            root = [root[x] if r == root[y] else r for r in root]
        want, _ = brute_groups(list(enumerate(a)), threshold)
        assert len(set(root)) == len(set(want.values()))


def slow_likeness(a, b):
    """Level by level: the share of sampled places that agree, less chance, weighted by the level's places."""
    (size_a, x), (size_b, y) = a, b
    longest, at, agree, whole = max(size_a, size_b), 0, 0.0, 0.0
    for level, places in enumerate(ef.PLACES):
        pairs = [(p, q) for p, q in zip(x[at : at + len(places)], y[at : at + len(places)]) if p != 255 or q != 255]
        at += len(places)
        if pairs:
            share = sum(p == q for p, q in pairs) / len(pairs)
            low = ef.FIRST << (level - 1) if level else 0
            weight = min(longest, ef.FIRST << level) - low
            agree += weight * (max(0, (share - 1 / 16) * 16 / 15) if level else share)
            whole += weight
    return agree / whole if whole else 1.0


def test_likeness_of_the_query_by_brute_force(spark):
    from skein.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op2_edit_embedding(spark, sf).collect()}

    def sketch(text):
        classes = ef.char_classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()
        stay, out, j = ef.STAY.reshape(ef.CLASSES, ef.PERIOD), [], 0
        for c in classes:
            k = int(stay[c, j % ef.PERIOD])
            out += [c] * k
            j += k
        return j, [int(ef.BITS[out[p], s % 64]) if p < j else 255 for s, p in enumerate(ef.ALL_PLACES.tolist())]

    sketches = [sketch(t) for _, t in rows]
    for k, (doc_id, text) in enumerate(rows):
        after, half, r = (k + 1) % len(rows), len(text) // 2, got[doc_id]
        edited = sketch(text[: len(text) - half] + rows[after][1][:half])
        assert abs(r.near_edited - slow_likeness(sketches[k], edited)) < 1e-9 and abs(r.near_next - slow_likeness(sketches[k], sketches[after])) < 1e-9
        for shared, other in ((r.bands_edited, edited), (r.bands_next, sketches[after])):
            own = [(p, q) for p, q in zip(sketches[k][1], other[1])]
            bands = [own[i : i + ef.BAND] for i in range(0, len(own) - ef.BAND + 1, ef.BAND)]
            assert shared == sum(all(p == q != 255 for p, q in band) for band in bands)
