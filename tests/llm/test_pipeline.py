"""The pipeline's stages against brute force, and its behaviour on odd rows."""

import sys
import zlib
from pathlib import Path

import numpy as np
from test_simhash import fingerprint, roots
from test_tokens import encoded, plain

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from skein.llm import langid, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_run_equals_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sure = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.35}
    kept = docs.filter(docs.doc_id.isin(sorted(sure)))
    clean = {r.doc_id for r in toxicity.score(kept, toxicity.fit(kept, labels)).collect() if not r.toxic}
    last = {}
    for r in docs.orderBy("doc_id").collect():
        if r.doc_id in clean:
            last[plain(r.text)] = (r.doc_id, r.text)
    rows = sorted(last.values())
    prints = [fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    want = []
    for doc_id, text in (rows[i] for i in sorted(set(root))):
        ids = encoded(text, 1)
        want += [(doc_id, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and np.mean(list(fill.values())) > 3500


def test_stages_keep_columns_and_take_odd_rows(spark, edge, empty):
    for table in (edge, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
