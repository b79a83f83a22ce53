"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from skein.llm import byte_bpe, dac, edit_fingerprint, exact_dedup, langid, maxent_lm, packing, sharding, simhash, toxicity
from skein.llm.common import LOWER, UPPER, read_table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.find_copies(read_table(spark, sf_dir, "documents"))


def op2_edit_embedding(spark, sf_dir):
    return edit_fingerprint.compare_with_edited(read_table(spark, sf_dir, "documents"))


def op3_rendezvous_sharding(spark, sf_dir):
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_maxent_lm(spark, sf_dir):
    return maxent_lm.score_corpus(read_table(spark, sf_dir, "documents"))


def op6_dac_tokens(spark, sf_dir):
    return dac.roundtrip(read_table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_edit_embedding, op3_rendezvous_sharding, op4_toxicity_chain, op5_maxent_lm, op6_dac_tokens, op7_pattern_packing, op8_byte_bpe, op9_language_id, op10_simhash)}

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH rows AS (
            SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t,
                   row_number() OVER (PARTITION BY doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS copy
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AND copy = 1 AS kept, sha256(t) AS text_sha256
        FROM rows WINDOW w AS (PARTITION BY t)""",
}
