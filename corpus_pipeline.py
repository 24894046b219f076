"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixture.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns the
documents that it keeps, with the columns it was given. ``run`` writes the result of each stage
as Parquet to the shared folder and reads it as the next one's documents. The mixture, the last
stage, returns a row per document it takes, with the number of times it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.llm import decontaminate, line_dedup, mixing, order_minhash, quality
from folioscore.session import workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score_quality(docs, quality.fit_quality(docs))
    return scored.filter("accepted").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a document of which no line is left goes."""
    done = line_dedup.dedup_lines(docs)
    kept = done.filter("n_dropped < n_lines").withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark)
    return found.filter("not contaminated").select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, and how often."""
    mixed = mixing.mix_sources(docs).withColumn("repeats", F.col("epochs") + F.col("selected"))
    return mixed.filter("repeats > 0").select(
        "doc_id", "source", "size", "source_size", "target", "repeats", "taken"
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixture_stage),
]

#: Stages 1 and 3 fit models and walk links, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = workspace(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
