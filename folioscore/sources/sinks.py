"""Writers of Markdown results and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KEY = ("filestem", "parser", "model")


def write_markdown(results: DataFrame, path: str) -> None:
    """Save ``(filestem, parser, model, markdown)``; a later save of the same key
    takes the place of an earlier one.

    Each save appends to the table of its parser and model with the time of the
    save, and ``read_saved`` keeps the newest. So nothing is rewritten to replace
    one document, other documents are never touched, and a job that failed half
    way and ran again changes nothing.
    """
    (
        results.select(*KEY, "markdown", F.current_timestamp().alias("saved"))
        .write.mode("append")
        .partitionBy("parser", "model")
        .parquet(path)
    )


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """The newest text of every saved key."""
    schema = "filestem string, markdown string, saved timestamp, parser string, model string"
    return (
        spark.read.schema(schema)
        .parquet(path)
        # an empty partition value comes back as null
        .withColumn("model", F.coalesce("model", F.lit("")))
        .groupBy(*KEY)
        .agg(F.max_by("markdown", "saved").alias("markdown"))
    )


def write_markdown_files(results: DataFrame, path: str) -> None:
    """Save the same rows as text, in folders ``parser=/model=/filestem=``.

    A text that ends with a newline is saved exactly; any other gets one, as the
    text format ends every record with it. One folder per document suits an
    export of chosen documents; tables belong in ``write_markdown``.
    """
    value = F.regexp_replace("markdown", r"\n\z", "").alias("value")
    (
        results.select(*KEY, value)
        .repartition(*KEY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("parser", "model", "filestem")
        .text(path)
    )


def write_metrics(long_metrics: DataFrame, path: str) -> None:
    """Save ``Metric, File1, File2, Value`` as CSV with a header.

    A ``mode`` column, where present, becomes a partition so that runs with and
    without Markdown do not replace each other.
    """
    writer = (
        long_metrics.write.mode("overwrite")
        .option("header", True)
        .option("partitionOverwriteMode", "dynamic")
    )
    if "mode" in long_metrics.columns:
        writer = writer.partitionBy("mode")
    writer.csv(path)
