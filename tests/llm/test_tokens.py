"""Exact dedup, sharding, token files, packing and byte-level BPE against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGE, LONG
from pyspark.sql import functions as F

from skein.llm import byte_bpe, common, dac, exact_dedup, packing, sharding
from skein.llm.common import LOWER_TABLE
from skein.llm.word_bpe import default_path


def plain(text):
    return (text or "").encode().translate(LOWER_TABLE)


def test_polynomial_hash_is_composable():
    data = np.frombuffer(random.Random(1).randbytes(50_000), np.uint8)
    offsets = np.array([0, 0, 3, 4096, 4097, 20_000, 50_000])
    for modulus, base in exact_dedup.MODULI:
        got = exact_dedup.polynomial_hashes(data, offsets, modulus, base, chunk=100)
        for a, b, h in zip(offsets[:-1], offsets[1:], got):
            want = 0
            for x in data[a:b].tolist():
                want = (want * base + x) % modulus
            assert h == want
        left, right = (int(got[4]), 15_903), (int(got[5]), 30_000)
        whole = int(exact_dedup.polynomial_hashes(data[4097:], np.array([0, 45_903]), modulus, base)[0])
        assert exact_dedup.combine(left, right, modulus, base) == (whole, 45_903)


@pytest.mark.parametrize("options", [{}, {"moduli": ((7, 3), (5, 2))}, {"most_bits": 64}, {"moduli": ((7, 3), (5, 2)), "most_bits": 64}])
def test_exact_dedup(edge, docs, options):
    for table in (edge, docs):
        rows = [(r.doc_id, plain(r.text)) for r in table.select("doc_id", "text").collect()]
        groups = {}
        for doc_id, text in rows:
            groups.setdefault(text, []).append(doc_id)
        got = exact_dedup.find_copies(table, **options).collect()
        assert len(got) == len(rows)
        kept = {}
        for r in got:
            text = next(t for d, t in rows if d == r.doc_id and hashlib.sha256(t).hexdigest() == r.text_sha256)
            assert r.keep_id == max((d for d in groups[text] if d is not None), default=None) and r.group_size == len(groups[text])
            kept[text] = kept.get(text, 0) + r.kept
        assert set(kept.values()) == {1}


def test_exact_dedup_drops_rows(edge, empty):
    left = exact_dedup.drop_rows(edge, exact_dedup.find_copies(edge))
    assert left.columns == edge.columns
    assert sorted(plain(r.text) for r in left.collect()) == sorted({plain(t) for _, t, *_ in EDGE})
    assert exact_dedup.find_copies(empty).count() == 0


def test_sharding(edge, docs, empty):
    for table in (edge, docs):
        got = sharding.assign(table).collect()
        want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in table.collect())
        assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty).count() == 0


def test_sharding_weights_and_growth(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(ids, weights=[1.0] * 7 + [3.0])
    counts = {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()}
    assert all(abs(counts[s] - 4000) < 300 for s in range(7)) and abs(counts[7] - 12_000) < 500
    assert abs(got.filter("grown_shard = 8").count() - 40_000 / 11) < 300


def encoded(text, end):
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        _tokenizer
    except NameError:
        _tokenizer = Tokenizer.from_file(default_path())
        _tokenizer.encode_special_tokens = True
    return np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_dac_codes():
    for widths in ((8, 8, 16), (8, 16, 8), (16, 16)):
        for high in (200, 70_000, 1 << 31):
            ids = np.random.default_rng(3).integers(0, high, 5000).astype(np.uint32)
            reader = dac.DacReader(dac.dac_encode(ids, widths))
            assert len(reader) == 5000 and (reader.slice(0, 5000) == ids).all()
            assert all(reader[i] == ids[i] for i in range(0, 5000, 37))
            assert (reader.slice(777, 3001) == ids[777:3001]).all() and not len(reader.slice(9, 9))
    assert len(dac.DacReader(dac.dac_encode(np.zeros(0, np.uint32)))) == 0


@pytest.mark.parametrize("options", [{}, {"rows_per_range": 7, "segment_ids": 100}])
def test_token_files(edge, docs, options):
    for table in (edge, docs):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
        want, start = [], 0
        for r in rows:
            ids = encoded(r.text, 2)
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = dac.roundtrip(table, **options).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_of_nothing(empty):
    assert dac.roundtrip(empty).count() == 0


def test_packing(edge, docs):
    for table in (edge, docs):
        got = packing.pack_documents(table).collect()
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = encoded(r.text, 1)
            want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(sequences) <= -(-sum(x[3] for x in want) // 4096) * 1.03 + 2


def test_packing_plan_fits_histogram():
    rng = np.random.default_rng(5)
    for n, scale in ((300, 900), (60_000, 700), (60_000, 3000)):
        lengths = np.clip(rng.lognormal(np.log(scale), 0.9, n).astype(int), 1, 4096)
        counts = np.bincount(lengths, minlength=4097)
        groups = packing.plan(counts)
        used = np.zeros(4097, np.int64)
        for content, times in groups:
            assert sum(a * m for a, m in content) <= 4096 and times > 0
            for a, m in content:
                used[a] += m * times
        assert (used == counts).all()
        plain_bins = sum(t for _, t in packing.best_fit(counts))
        assert sum(t for _, t in groups) <= plain_bins * 1.01 + 1
    # the least squares fit reproduces a histogram that patterns can make
    counts = np.zeros(4097)
    counts[[1000, 3096, 2048]] = 40, 40, 20
    assert sum(t for _, t in packing.plan(counts)) == 50


def test_byte_bpe(edge, docs):
    import tiktoken
    import public_tokenizers as P

    merger = byte_bpe.merger(byte_bpe.default_path())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merger.ranks, special_tokens={})
    for table in (edge, docs):
        rows = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        want = []
        for doc_id, text in rows:
            ids = own.encode_ordinary(text)
            want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in byte_bpe.encode_decode(table).collect())
    for r in byte_bpe.encode_documents(docs.limit(20)).collect():
        text = docs.filter(F.col("doc_id") == r.doc_id).first().text.encode()
        ends = [*r.starts[1:], len(text)]
        assert all(merger.tokens[i] == text[a:b] for i, a, b in zip(r.ids, r.starts, ends))


def test_byte_bpe_on_odd_texts():
    import tiktoken
    import public_tokenizers as P

    merger = byte_bpe.merger(byte_bpe.default_path())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merger.ranks, special_tokens={})
    rng = random.Random(8)
    alphabet = list("aestmdrvlL' \n\t\r01.,!é数٣  　😀ß'") + ["'s", "'re", "'ll", " '", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)] + ["", " ", "  ", "'", "''s", "a's't", "x" * 5000, "ab" * 2000 + "\n" * 300, LONG[:9000]]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, at, _ = merger.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.encode_ordinary(text), repr(text)


def test_dac_segment_header_is_readable(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    dac.write_tokens(docs, path)
    row = spark.read.parquet(path).orderBy("part", "segment").first()
    (n,) = struct.unpack_from("<I", row.payload)
    assert n == row.n_docs
    assert dac.read_tokens(spark, path, with_ids=True).filter("doc_id = 0").first().ids[-1] == 2


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    from skein.llm.word_bpe import WordEncoder

    plain_library = Tokenizer.from_file(default_path())
    start, end = "<|startoftext|>", "<|endoftext|>"
    texts = ["", None, end, f"a {end} b", f"a{start}b{end}", f"  x \n{end}\t{start}y ", f"<{end}>", end * 3, end.upper(), end[:7], end[7:], f"don{end}'t", f"e{end}\u0301x é{end}é", "<|" + end + "text|>", "plain text", f"<{start[:5]}{start}1{end}2"]
    rng = random.Random(5)
    texts += ["".join(rng.choice([start, end, end[:6], end[6:], " ", "\n", "Ab", "é", "7", "<|", "|>", "'s", "\u00a0", "の"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    want = [plain_library.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.array(["cut", *texts])[1:]
    for most in (10_000, 3):
        tool = WordEncoder(default_path())
        tool.most_cached = most
        ids, at = tool.encode(column)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want and at[-1] == len(ids)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in dac.roundtrip(frame).collect()}
    for k, ids in enumerate(want):
        assert got[k].n_tokens == len(ids) + 1 and got[k].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())


def test_exact_dedup_tells_rows_without_id_apart_whatever_the_bits(spark):
    texts = [f"text {k:03d}" for k in range(80)]
    rows = [(k if k % 4 == 0 else None, t) for k, t in enumerate(texts)] + [(None, texts[5]), (900, texts[7])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (1 << 27, 64):
        got = exact_dedup.find_copies(frame, ((7, 3), (5, 2)), most).collect()
        digests = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
        assert len(got) == len(rows)
        for r in got:
            text = digests[r.text_sha256]
            assert r.group_size == (2 if text in (texts[5], texts[7]) else 1)
            assert r.keep_id == max((d for d, t in rows if t == text and d is not None), default=None)


def test_dropped_rows_by_any_column_names(spark):
    """Columns called like our own, repeated ids, ties, bytes that are no UTF-8."""
    rows = [(1, b"One", 5, 1, "b"), (1, b"one", 5, 2, "a"), (1, b"two \xff", 5, 3, "c"), (2, b"two \xff", 5, 4, "d"), (None, b"x", 5, 5, "e"), (None, b"x", 5, 5, "e"), (3, None, 5, 6, "f"), (4, b"", 5, 7, "g")]
    frame = spark.createDataFrame(rows, "DOC_ID long, raw binary, _drop int, _key int, _again string").selectExpr("doc_id", "cast(raw as string) as text", "_drop", "_key", "_again", "1 as _row", "2 as _id", "3 as _sha").repartition(3)
    left = exact_dedup.drop_rows(frame, exact_dedup.find_copies(frame))
    assert left.columns == frame.columns and left.dtypes == frame.dtypes
    got = sorted((r.doc_id or 0, r._key) for r in left.collect())
    # of the two rows with id 1 and text one, the first as JSON: "One" comes before "one"
    assert got == [(0, 5), (1, 1), (2, 4), (4, 7)]


def test_heavy_keys_join_like_others(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) as k").repartition(4)
    right = spark.range(3100).selectExpr("id as k", "id * 2 as v").filter("k % 5 <> 1")
    heavy = common.heavy_keys(left, ["k"], 100)
    assert [r.k for r in heavy.collect()] == [7]
    for how in ("inner", "left"):
        want = sorted((r.id, r.k, r.v or -1) for r in left.join(right, ["k"], how).collect())
        assert sorted((r.id, r.k, r.v or -1) for r in common.spread_join(left, right, ["k"], how, heavy).collect()) == want
    assert common.heavy_keys(left, ["k"], 0, 4).count() == 1 and common.heavy_keys(left, ["k"], 0, 2).count() == 0




def test_shards_by_brute_force(spark):
    """Every row of the query, from MD5, logarithms and CRC-32 of the standard library."""
    import math

    from skein.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_rendezvous_sharding(spark, sf).collect()
    assert len(got) == len(texts)

    def score(doc_id, shard):
        return -1 / math.log((int(hashlib.md5(f"{doc_id}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    slots = {}
    for r in got:
        scores = [score(r.doc_id, k) for k in range(25)]
        assert r.shard == max(range(24), key=scores.__getitem__) and r.grown_shard == max(range(25), key=scores.__getitem__)
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key")
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_tokens_by_their_number(spark, docs, tmp_path):
    """Single ids out of the written files, against all of them in order."""
    path = f"file://{tmp_path}/tokens"
    dac.write_tokens(docs, path, rows_per_range=30, segment_ids=3000)
    rows = sorted(dac.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    every = [i for r in rows for i in r.ids]
    rng = random.Random(3)
    places = [0, len(every) - 1, *(rng.randrange(len(every)) for _ in range(60))]
    got = {r.place: r.id for r in dac.tokens_at(spark, path, [*places, -1, len(every), 10**12]).collect()}
    assert got == {p: every[p] for p in places}
