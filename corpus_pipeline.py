"""The corpus pipeline: toxicity, exact copies, near copies, mixing, encoding.

Every stage takes null and empty texts, very long ones, repeated rows, rows without a doc_id, empty tables and columns of
any further name; what becomes of each is said at the stage. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import common, exact_dedup, mixing, ngram_join, sentence_piece, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; it learns from the labelled ones among docs.

    Null and empty texts have the score of no sentences and stay where that is below the limit. Repeated rows go or stay
    together. Without labels of both kinds nothing is toxic. An empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null counts as empty, so of null and empty texts one row stays; of repeated rows one stays; a null doc_id is the
    smallest. An empty table stays empty.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Null and blank texts and rows without a doc_id stay. An empty table stays empty.
    """
    return ngram_join.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the copy at which a source's budget ends has the words up to there.

    Null and blank texts have no words and are not taken. Repeated rows each have their place; a null source is a source.
    An empty table stays empty.
    """
    mixed = mixing.mixed(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and of the text that they decode to; null counts as empty. A row a row."""
    return sentence_piece.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentence_piece", encode),
]

#: The last stage's ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
