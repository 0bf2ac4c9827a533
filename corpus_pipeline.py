"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; every result is
written as Parquet and read again before the next stage.

Odd rows: a null text counts as empty everywhere; empty and very long texts are
judged whole.  Rows without doc_id stay unless quality or benchmark rejects
them, and rows of one doc_id are told apart by their texts.  Of equal rows, one
stays (the near-duplicate stage).  Ties are settled by doc_id, then by hashes of
the text.  An empty table, a missing label or an empty benchmark give defined
results in every stage, and columns of any other name come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontamination, mixing, near_dedup, quality, token_output
from quadrille.llm.shared import fresh, saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the whole table, does not reject."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs, threshold=0.8, size=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal proportions, in a global random order."""
    copy, order = fresh(docs, "copy", "shuffle_key")
    return mixing.mix(docs, copy=copy, order=order).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token-ID output", tokens),
]

#: A classifier trained in the run has no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
