"""SimHash fingerprints, links and components against brute force."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skein.llm import simhash
from skein.llm.common import LOWER_TABLE
from skein.llm.components import components


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER_TABLE))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_near_duplicates(edge, docs):
    for table in (edge.filter("doc_id is not null"), docs):
        rows = [(r.doc_id, fingerprint(r.text)) for r in table.select("doc_id", "text").orderBy("doc_id").collect()]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
        root = roots(len(rows), pairs)
        low = {}
        for i, r in enumerate(root):
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
        want = sorted((d, f"{fp:016x}", low[root[i]]) for i, (d, fp) in enumerate(rows))
        assert sorted(tuple(r)[:3] for r in simhash.near_duplicates(table).collect()) == want


def test_empty_and_null_ids(edge, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(edge).count() == edge.count()
    one = edge.filter("doc_id is null or doc_id <> 9")
    kept = simhash.decisions(one).filter("kept").select("doc_id", "text_sha256").distinct().count()
    assert kept == simhash.near_duplicates(one).select("component_id").distinct().count()


def planted(seed=4):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    out = [base]
    for k in range(3):  # chains and clusters of one and two flipped bits
        flips = (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(k % 2) << rng.integers(0, 64, 300).astype(np.uint64))
        out.append(out[-1] ^ flips)
    hub = base[0]
    out.append(np.array([hub ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(a)], np.uint64))
    shared_half = (base[1] & np.uint64(0xFFFFFFFF)) | (rng.integers(0, 1 << 31, 3000, dtype=np.uint64) << np.uint64(32))
    out.append(shared_half)
    return np.unique(np.concatenate(out))


def check_links(spark, fps, **options):
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(frame, **options)
    got = {(r.a, r.b) for r in links.collect()}
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for a, b in got:
        assert 0 < (np.int64(a).view(np.uint64) ^ np.int64(b).view(np.uint64)).item().bit_count() <= 2
    pairs = []
    for i in range(1, len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2):
            pairs.append((i, int(j)))
    assert roots(len(fps), pairs) == roots(len(fps), [(index[a], index[b]) for a, b in got])
    assert len(got) < 40 * len(fps)


def test_links_in_large_buckets(spark, monkeypatch):
    fps = planted()
    check_links(spark, fps)
    a, b = simhash.ball_links(fps.view(np.int64))
    monkeypatch.setattr(simhash, "BALL_KEYS", 10_000)
    c, d = simhash.ball_links(fps.view(np.int64))
    assert set(zip(a.tolist(), b.tolist())) == set(zip(c.tolist(), d.tolist()))


def test_links_with_heavy_values_split(spark):
    fps = planted(9)
    keys, values = simhash.variants(fps.view(np.int64), np.sort(np.array([int(fps[5]) & 0xFFFFFFFF, 1 << 32 | int(fps[9]) >> 32])))
    order = np.argsort(keys, kind="stable")
    a, b = simhash.bucket_links(keys[order], values[order])
    pairs = {(i, int(j)) for i in range(1, len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2)}
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert roots(len(fps), pairs) == roots(len(fps), [(index[x], index[y]) for x, y in zip(a.tolist(), b.tolist())])


def test_components_of_chains(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1000, 1300).select(F.lit(1000).alias("a"), F.col("id").alias("b")))
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(401)}, **{i: 1000 for i in range(1000, 1300)}}
