"""Corpus pipeline: quality classifier, near-dedup, secret redaction, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Null texts count as empty in
every decision, rows without an id are rows like others, and an empty table gives an empty one. Columns beyond those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import read, write_table
from attestry.llm.mixing import apply_mix
from attestry.llm.near_text import drop_near_duplicates
from attestry.llm.pieces import piece_report
from attestry.llm.quality import keep_quality
from attestry.llm.secrets import fit_field, redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score as texts of zeros; repeated rows are judged each."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id. Equal rows go down to one; null and empty texts are one class."""
    return drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret becomes a mark, and n_chars follows the text. Null texts stay null and keep their n_chars."""
    out = redact_secrets(docs, fit_field(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it; one that is taken for less than half its words goes, and so do those without words."""
    return apply_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, round_trip, pieces) of every document left; null texts have no pieces."""
    return piece_report(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: The trained stages cannot be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs)
    return docs
