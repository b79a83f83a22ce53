"""Rows that no operator expects, for all of them: bytes that are no UTF-8, an id and a text that a third of all rows have."""

import hashlib

from pyspark.sql import functions as F

from skein.llm import byte_bpe, components, dac, edit_fingerprint, exact_dedup, langid, maxent_lm, packing, sharding, simhash, toxicity

LABELS = "doc_id long, quality int, toxic int"


def valid(raw):
    return (raw or b"").decode("utf-8", "replace")


def test_torn_texts(spark, torn):
    n = torn.count()
    raws = {r.doc_id: bytes(r.raw or b"") for r in torn.selectExpr("doc_id", "cast(text as binary) as raw").collect()}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (5, 0, 0)], LABELS)
    got = {r.doc_id: r for r in exact_dedup.find_copies(torn).collect()}
    assert len(got) == n and all(got[k].text_sha256 == hashlib.sha256(v).hexdigest() for k, v in raws.items())
    got = {r.doc_id: r for r in edit_fingerprint.compare_with_edited(torn).collect()}
    assert len(got) == n and all(got[k].n_chars == len(valid(v)) for k, v in raws.items())
    assert sharding.assign(torn).count() == n
    assert toxicity.score(torn, toxicity.fit(torn, labels)).count() == n
    assert maxent_lm.score_corpus(torn).count() == n and maxent_lm.score_corpus(torn.limit(0)).count() == 0
    assert dac.roundtrip(torn).count() == n and packing.pack_documents(torn).count() == n
    got = {r.doc_id: r for r in byte_bpe.encode_decode(torn).collect()}
    assert all(got[k].decoded_sha256 == hashlib.sha256(valid(v).encode()).hexdigest() for k, v in raws.items())
    assert langid.identify(torn).count() == n and simhash.near_duplicates(torn).count() == n
    for step in (langid.keep_identified, lambda d: toxicity.keep_clean(d, labels), lambda d: exact_dedup.drop_rows(d, exact_dedup.find_copies(d)), lambda d: exact_dedup.drop_rows(d, simhash.decisions(d))):
        assert step(torn).columns == torn.columns and step(torn).count() <= n


def test_a_third_of_all_rows_on_one_id_and_text(spark, docs, monkeypatch):
    """Results as without the heap, for operators that join or order by what is heaped; heavy keys from 20 rows on."""
    heavy = lambda left, key: left.groupBy(*key).count().filter("count > 20").select(*key)
    monkeypatch.setattr("skein.llm.common.heavy_keys", heavy)
    monkeypatch.setattr(components, "heavy_keys", heavy)
    heap = spark.range(100).selectExpr("cast(7 as long) as doc_id", "'the same text for all of them here' as text")
    table = docs.select("doc_id", "text").filter("doc_id <> 7").unionByName(heap).repartition(5)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    copies = exact_dedup.find_copies(table).filter("doc_id = 7").collect()
    assert len(copies) == 100 and {(r.keep_id, r.group_size) for r in copies} == {(7, 100)} and sum(r.kept for r in copies) == 1
    near = simhash.near_duplicates(table).collect()
    assert len(near) == len(rows) and {(r.component_id, r.component_size >= 100) for r in near if r.doc_id == 7} == {(7, True)}
    edits = [r for r in edit_fingerprint.compare_with_edited(table, 16).collect() if r.doc_id == 7]
    assert len(edits) == 100 and sum(r.near_next == 1 for r in edits) >= 99 and len({r.fingerprint for r in edits}) == 1
    ids = [r for r in dac.roundtrip(table, rows_per_range=16).collect() if r.doc_id == 7]
    assert len({r.start for r in ids}) == 100 and len({(r.n_tokens, r.ids_crc32) for r in ids}) == 1
    shards = sharding.assign(table).filter("doc_id = 7").collect()
    assert len({r.shard for r in shards}) == 1 and len({r.slot for r in shards}) == 100
    assert maxent_lm.score_corpus(table).count() == len(rows) and packing.pack_documents(table).filter("doc_id = 7 and piece = 0").count() == 100
    left = exact_dedup.drop_rows(table, exact_dedup.find_copies(table))
    assert left.filter("doc_id = 7").count() == 1


def test_links_of_hubs_are_joined_in_place(spark, monkeypatch):
    """A hub of many spokes, chains behind it, and single links, with and without heavy keys."""
    rows = [(0, k) for k in range(1, 200)] + [(k, 1000 + k) for k in range(1, 100)] + [(5000, 5001), (5001, 5002)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(3)
    want = {n: (0 if n < 5000 else 5000) for r in rows for n in r}
    assert {r.node: r.root for r in components.components(links).collect()} == want
    heavy = lambda left, key: left.groupBy(*key).count().filter("count > 20").select(*key)
    monkeypatch.setattr("skein.llm.common.heavy_keys", heavy)
    monkeypatch.setattr(components, "heavy_keys", heavy)
    assert {r.node: r.root for r in components.components(links).collect()} == want


def test_shards_are_written_by_number(spark, edge, tmp_path):
    path = f"file://{tmp_path}/shards"
    try:
        sharding.write_shards(edge, path, 5, name="LENGTH")
        raise AssertionError("a column is called like the folders")
    except ValueError as e:
        assert "LENGTH" in str(e)
    sharding.write_shards(edge, path, 5)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*edge.columns, "shard"} and back.count() == edge.count()
    want = {(r.doc_id, r.shard) for r in sharding.assign(edge, 5).collect()}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == want


def test_languages_of_a_dirty_column(spark):
    rows = [(k, f"some words of kind {k % 3} {'abc' * (k % 3)} again", ("en", "fr", f"x{k}")[k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, 2).languages == ["en", "fr"] and len(langid.fit(docs).languages) == 102
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit("zz")), langid.fit(docs, 2)).collect()} <= {"en", "fr"}
