"""Whole evaluation: variants to metric rows, for all documents at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.functions.normalize import maybe_strip, mode_label
from folioscore.operators.metrics import METRICS, evaluate_pairs
from folioscore.operators.pairs import TILE
from folioscore.operators.reshape import metrics_long, similarity_matrix
from folioscore.sources.files import DEFAULT_PARSERS, scan_all_variants
from folioscore.sources.sinks import write_metrics


def evaluate(
    variants: DataFrame,
    strip: bool = True,
    metrics: Sequence[str] = METRICS,
    tile: int | None = None,
) -> DataFrame:
    """Wide metrics of every pair of every document, with the ``mode`` used.

    Texts are stripped once per variant, before the shuffle that pairs them. ``tile`` is as in
    ``evaluate_pairs``.
    """
    cleaned = variants.withColumn("text", maybe_strip("text", strip))
    return evaluate_pairs(cleaned, metrics, tile=tile).withColumn(
        "mode", F.lit(mode_label(strip))
    )


def evaluate_all(
    spark: SparkSession,
    path: str,
    out: str,
    parsers: Sequence[str] = DEFAULT_PARSERS,
    strip: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Evaluate a folder of Markdown files and save the metric rows under
    ``out``; returns the long rows and the matrices.

    The wide scores are written once and read back, so that the CSV and the
    matrices do not compute the pairs twice and a lost executor costs only its
    own tasks.
    """
    wide_path = f"{out.rstrip('/')}/wide"
    evaluate(scan_all_variants(spark, path, parsers), strip, METRICS, tile=TILE).write.mode(
        "overwrite"
    ).partitionBy("mode").option("partitionOverwriteMode", "dynamic").parquet(wide_path)
    wide = spark.read.parquet(wide_path).where(F.col("mode") == mode_label(strip))
    rows = metrics_long(wide)
    write_metrics(
        rows.select("Metric", "File1", "File2", "Value", F.lit(mode_label(strip)).alias("mode")),
        f"{out.rstrip('/')}/metrics",
    )
    return rows, similarity_matrix(rows)
