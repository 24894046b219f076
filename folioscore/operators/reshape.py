"""Metric tables in other shapes: long, matrix, report, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscore.operators.metrics import METRICS, column_of
from folioscore.sources.naming import variant_label


def metrics_long(wide: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``Metric, File1, File2, Value`` rows; ``metric_pos`` and the ordinals
    give the report order."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_pos"),
                F.lit(m).alias("Metric"),
                F.col(column_of(m)).alias("Value"),
            )
            for i, m in enumerate(metrics)
        ]
    )
    checked = [c for c in wide.columns if c == "checked"]
    return wide.select(
        "filestem",
        F.inline(rows),
        F.col("file1").alias("File1"),
        F.col("file2").alias("File2"),
        "ord1",
        "ord2",
        *checked,
    ).select(
        "filestem", "metric_pos", "Metric", "File1", "File2", "Value", "ord1", "ord2", *checked
    )


def in_report_order(long_metrics: DataFrame) -> DataFrame:
    """Rows sorted as in the metric file of each document."""
    return long_metrics.orderBy("filestem", "metric_pos", "ord1", "File1", "ord2", "File2")


def similarity_cells(long_metrics: DataFrame) -> DataFrame:
    """Both triangles of each matrix as cells: row, column and their order, value."""

    def cell(ord_row: str, row: str, ord_col: str, col: str):
        return F.struct(
            F.col(row).alias("File"),
            F.col(ord_row).alias("ord_row"),
            F.col(ord_col).alias("ord_col"),
            F.col(col).alias("file_col"),
        )

    upper, lower = cell("ord1", "File1", "ord2", "File2"), cell("ord2", "File2", "ord1", "File1")
    both = F.when(F.col("File1") == F.col("File2"), F.array(upper)).otherwise(
        F.array(upper, lower)
    )
    return long_metrics.select("filestem", "Metric", F.inline(both), "Value")


def similarity_matrix(long_metrics: DataFrame) -> DataFrame:
    """One matrix row per document, metric and file.

    ``columns`` are the document's files in order, ``values`` the similarities to
    them, 0 where a pair is missing. Cells are gathered to rows, and the rows are dealt out by
    matrix once; the columns are gathered from that same exchange, so the pairs are scored
    once. A row whose pairs are complete, as those of ``evaluate_pairs`` are, has its
    values in order already; only a row with fewer looks up what it has.
    """
    rows = (
        similarity_cells(long_metrics)
        .groupBy("filestem", "Metric", "File")
        .agg(
            F.min("ord_row").alias("ord_row"),
            F.sort_array(F.collect_list(F.struct("ord_col", "file_col", "Value"))).alias("_cells"),
        )
        .repartition("filestem", "Metric")
    )
    # asking for the cells keeps both readers of the exchange alike
    file = F.when(F.size("_cells") > 0, F.struct("ord_row", "File"))
    columns = rows.groupBy("filestem", "Metric").agg(
        F.sort_array(F.collect_list(file)).alias("_columns")
    )

    def value(c):
        found = F.filter("_cells", lambda x: x["file_col"] == c["File"])
        return F.coalesce(F.get(found, 0)["Value"], F.lit(0.0))

    complete = F.size("_cells") == F.size("_columns")
    return rows.join(columns.hint("merge"), ["filestem", "Metric"]).select(
        "filestem",
        "Metric",
        "File",
        F.transform("_columns", lambda c: c["File"]).alias("columns"),
        F.when(complete, F.transform("_cells", lambda c: c["Value"]))
        .otherwise(F.transform("_columns", value))
        .alias("values"),
    )


def evaluation_report(wide: DataFrame) -> DataFrame:
    """Printable summary per pair, values to four decimals; with word counts
    where the table has them."""
    title = F.concat(
        F.lit("Evaluation Results: "),
        variant_label(F.col("file1")),
        F.lit(" vs "),
        variant_label(F.col("file2")),
    )
    # Report captions.
    captions = (
        ("Cosine Similarity", "cosine"),
        ("Word Overlap Ratio", "word_overlap"),
        ("Levenshtein Ratio", "levenshtein"),
        ("ROUGE-1 Score", "rouge_1"),
        ("ROUGE-2 Score", "rouge_2"),
        ("ROUGE-L Score", "rouge_l"),
    )
    lines = [F.format_string(f"{text}: %.4f", F.col(name)) for text, name in captions]
    if "common" in wide.columns:
        one, two = variant_label(F.col("file1")), variant_label(F.col("file2"))
        lines += [
            F.format_string("Words in %s: %d", one, F.col("words_1")),
            F.format_string("Words in %s: %d", two, F.col("words_2")),
            F.format_string("Common words: %d", F.col("common")),
            F.format_string("Unique to %s: %d", one, F.col("only_1")),
            F.format_string("Unique to %s: %d", two, F.col("only_2")),
        ]
    return wide.select(
        "filestem",
        "file1",
        "file2",
        title.alias("title"),
        F.concat_ws("\n", *lines).alias("report"),
    )


def rank_against_checked(long_metrics: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Other variants of each document ranked by likeness to the checked one.

    ``checked`` has ``filestem, file``; rows of ``evaluate_checked`` have it as a
    column and need none. A window orders one document's variants for one metric.
    """
    joined = long_metrics
    if checked is not None:
        named = checked.select("filestem", F.col("file").alias("checked"))
        joined = long_metrics.drop("checked").join(named, "filestem")
    joined = joined.where(
        (F.col("File1") == F.col("checked")) | (F.col("File2") == F.col("checked"))
    )
    other = F.when(F.col("File1") == F.col("checked"), F.col("File2")).otherwise(F.col("File1"))
    scored = joined.where(F.col("File1") != F.col("File2")).select(
        "filestem", "Metric", "checked", other.alias("file"), F.col("Value")
    )
    order = Window.partitionBy("filestem", "Metric").orderBy(F.col("Value").desc())
    return scored.withColumn("rank", F.rank().over(order))
