"""A corpus pipeline: documents of good quality, each text once, without secrets, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from busframe.llm.common import documents, written
from busframe.llm.exact_dedup import drop_copies
from busframe.llm.near_dedup import keep_one
from busframe.llm.packing import pack
from busframe.llm.quality import keep_good
from busframe.llm.secret_scan import mask_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the line field reject go, those with a null or empty text among them.

    Rows are judged one by one: a null or repeated doc_id makes no difference. All columns stay as they are."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; null counts as empty.

    A null doc_id is larger than any other, and of a group of null ids alone all stay; so do rows that share the smallest
    doc_id. near_dedup, which numbers such rows, leaves one of them."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one with the smallest doc_id stays.

    Rows with a null doc_id are documents of their own, after all others. Rows that share a doc_id are one document, of
    which one row of each text stays. Null and empty texts are copies of each other."""
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, with its other columns. A null text stays null."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null text is one token, rows that repeat are packed each."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("best_fit_packing", packing)]

#: The quality field and the tokeniser have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
