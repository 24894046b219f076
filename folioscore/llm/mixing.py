"""Mix sources to target weights by weighted sampling keys (DataFrame functions only).

Each source gets a budget of words. Whole epochs come first: a source whose budget is twice its
size is taken twice. The rest is filled by Efraimidis-Spirakis sampling: a document's key is an
exponential variate divided by its quality weight, and documents are taken in order of the key
until their prefix sum reaches the budget. The document on the edge is taken if that brings the
sum nearer to the budget.

A source may hold most of the rows, so its order is cut in ``BUCKETS`` ranges of the key: sums
per range are pre-aggregated, their prefix sums are taken over at most ``BUCKETS`` rows per source,
and documents are sorted within a range only. The table of documents that is shuffled has no text.
It is written once to the shared folder, because both the budgets and the selection read it.

Budgets: with weight ``w`` a source gets ``min(cap, w * level)``, with one level for all, such that
the budgets sum to the wanted share of all sizes; that equals sharing the excess over the caps anew
by weight until no source is above its cap. Only a row per source takes part in this.

Defined results: a null or empty text has size 0 and is taken 0 words. The null source is one
source, last in order. Repeated rows are documents of their own; rows equal in id and text take the
place in order of any one of them. Without words all budgets are 0. Weights that are null or not
above 0 count as 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscore.session import workspace

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less where marks that prose lacks stand in the text."""
    marks = F.length(text) - F.length(F.translate(text, "#$%&*|!<>{}=~^_\\", ""))
    share = marks / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(1.0) / (1 + 10 * share), F.lit(1.0))


def uniform(key: Column, seed: int) -> Column:
    """A fixed variate in (0, 1) for a key."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Budgets per source: ``sizes`` has ``source, source_size``; adds ``target``.

    Sources in code point order, null last, take the weights in turn.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
        .withColumn("_cap", F.col("source_size") * float(cap))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every) * float(share))
    )
    # the level if all sources before this one are at their cap and none from here on is
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    # the first source that its level leaves below the cap has the level of all
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", (-F.col("_level")).alias("_down")))
    leveled = ranked.withColumn("_level", level).withColumn("_level", -F.min(fits).over(every)["_down"])
    share_of = F.col("_weight") * F.coalesce("_level", F.col("_ratio"))
    return leveled.select(
        "source", "source_size", F.least(F.col("_cap"), share_of).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    weight: Column | None = None,
) -> DataFrame:
    """Row per document: ``doc_id, source, size, source_size, target, taken, epochs, selected``.

    ``taken`` is the words that the mix takes of the document, repeats counted:
    ``size * (epochs + selected)``.
    """
    spark = docs.sparkSession
    text = F.col("text")
    given = quality_weight(text) if weight is None else weight
    heavy = F.when(given > 0, given).otherwise(1.0)
    path = workspace(spark, "mix")
    (
        docs.select(
            "doc_id",
            "source",
            word_count(text).alias("size"),
            (-F.log(uniform(F.col("doc_id"), seed)) / heavy).alias("key"),
        )
        .withColumn("bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("key")))).cast("int"))
        .write.mode("overwrite").parquet(path)
    )
    keyed = spark.read.parquet(path)
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    sizes = buckets.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).withColumn(
        "epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .select(
            "_source", F.col("bucket").alias("_bucket"), "_start", "source_size", "target", "epochs"
        )
    )
    so_far = (
        Window.partitionBy("source", "bucket")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ordered = keyed.withColumn("_before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    joined = ordered.join(
        starts,
        (F.col("bucket") == F.col("_bucket")) & F.col("source").eqNullSafe(F.col("_source")),
    )
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    selected = (F.col("_start") + F.col("_before") + F.col("size") / 2) <= rest
    return joined.withColumn("selected", selected.cast("long")).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("epochs") + F.col("selected"))).alias("taken"),
        "epochs",
        "selected",
    )
