"""Writers: whole exports, learners' copies and package contents. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.quiz import learner_view


def write_json(df: DataFrame, path: str) -> None:
    """With the answer key; nulls are kept as nulls."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_learner_json(questions: DataFrame, path: str) -> None:
    """Without correct answers, explanations and sources."""
    write_json(learner_view(questions), path)


def append_entries(chained: DataFrame, path: str) -> None:
    """Adds entries of trails, partitioned by job; a job has one writer."""
    chained.write.mode("append").partitionBy("job_id").json(path)


def manifest(sections: DataFrame, version: str = "1.2") -> DataFrame:
    """(doc_id, item, resource, file, ord): what a package of each document holds, its sections in order and the assessment."""
    pages = sections.select("doc_id", F.concat(F.lit("item_"), "id").alias("item"), F.concat(F.lit("res_"), "id").alias("resource"), F.concat("id", F.lit(".html")).alias("file"), F.col("order").alias("ord"))
    test = sections.select("doc_id").distinct().select("doc_id", F.lit("item_assessment").alias("item"), F.lit("res_assessment").alias("resource"), F.lit("assessment.html").alias("file"), F.lit(99).alias("ord"))
    return pages.union(test).withColumn("schema_version", F.lit("1.2" if version == "1.2" else "2004 4th Edition"))
