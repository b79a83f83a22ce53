"""Corpus cleaning from raw documents to packed training sequences.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs, whatever their names.

Defined results of all stages: an empty table gives an empty result; a null text counts as empty; very long texts are
read whole; bytes that are no UTF-8 count as U+FFFD where characters matter; repeated rows are decided on each, unless a
stage says otherwise; a null doc_id is an id like others, below all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, langid, packing, simhash, toxicity
from skein.llm.common import materialize, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (no letters, null and empty texts among them, or no language is ahead: all
    score under 0.35) go; a score of 0.35 stays. Without a lang to learn from all go."""
    return langid.keep_identified(docs)


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic (a score of 0.5 is) go. Without labelled documents of both kinds, or without labels, all stay."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty ones are equal), the one with the largest doc_id stays; of rows with that id and text, one."""
    return exact_dedup.drop_rows(docs, exact_dedup.find_copies(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the one with the smallest doc_id stays (of several with it, the text with the smallest digest); texts without words are near copies of each other."""
    return exact_dedup.drop_rows(docs, simhash.decisions(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place; an empty text is one piece of its end id."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_chain),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and call tokenizers, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
