"""Corpus preparation in five stages, each written and read again by whoever runs it.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import exact_dedup, line_quality, near_dedup, packing, secrets
from vellum.llm.columns import discard, shared_folder
from vellum.llm.queries import table, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score is below the threshold; learns from the labels of those it is given."""
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = line_quality.score_documents(docs, model, keep=[c for c in COLUMNS if c != "doc_id"])
    return scored.where(F.col("score") >= line_quality.THRESHOLD).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of identical texts, the row with the largest doc_id."""
    return exact_dedup.without_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one with the least doc_id."""
    return near_dedup.without_near_duplicates(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret, and every encoded part that hides one, by a mark; all documents stay."""
    clean = secrets.find_secrets(docs, redact=True, keep=["lang", "source", "n_chars"])
    changed = F.col("spans") != ""
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(changed, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secret_scan), ("packing", pack)]

#: No stage but the second can be said in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with each one's result written to the shared folder and read again."""
    docs, folder, before = table(spark, sf_dir, "documents"), shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
