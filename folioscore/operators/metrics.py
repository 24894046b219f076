"""Similarity metrics of variant pairs.

A metric has two halves: *features* of one text, made once per variant before
the shuffle, and a *score* of two feature sets, made after the pair join. Sets
are compared with Spark's hash-based array functions inside the joined row, so
no token is ever exploded into a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscore.functions import sequences, tokens
from folioscore.operators.pairs import PAIR_KEY, tiled_pairs, turned, variant_pairs

# Metric names in report order.
METRICS = ("word_overlap", "levenshtein", "cosine", "rouge-1", "rouge-2", "rouge-l")
# ROUGE-L of summaries, on request: distinct words on the common subsequences of
# all sentence pairs, over the distinct words of each text.
UNION_ROUGE_L = "rouge-l-union"

# Inverse document frequency of a term found in one of two texts (smoothed); a
# term in both texts has 1.
IDF_ONE_OF_TWO = math.log(3 / 2) + 1
# Fixed value: the term that keeps the ROUGE F-score defined at zero.
ROUGE_EPSILON = 1e-8

_NEEDS = {
    "word_overlap": ("words",),
    "levenshtein": ("text",),
    "cosine": ("counts", "squares"),
    "rouge-1": ("unigrams",),
    "rouge-2": ("bigrams",),
    "rouge-l": ("sentence", "word_count"),
    "rouge-l-union": ("unigrams", "sentences"),
}


def column_of(metric: str) -> str:
    """Column name of a metric in wide tables."""
    return metric.replace("-", "_")


def with_features(
    variants: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Adds the columns that ``metrics`` compare; returns them by name. Other
    columns go, except those of ``keep``."""
    needed = [c for m in metrics for c in _NEEDS[m]]
    wanted = list(dict.fromkeys(needed))
    out = variants
    if any(c in wanted for c in ("unigrams", "bigrams", "sentence")):
        out = out.withColumn("sentence", tokens.rouge_text(F.col("text")))
    if "sentences" in wanted:
        out = out.withColumn("sentences", tokens.rouge_sentences(F.col("text")))
    if "word_count" in wanted:
        out = out.withColumn("word_count", F.size(tokens.rouge_words(F.col("sentence"))))
    if "unigrams" in wanted:
        out = out.withColumn("unigrams", tokens.rouge_unigrams(F.col("sentence")))
    if "bigrams" in wanted:
        out = out.withColumn("bigrams", tokens.rouge_bigrams(F.col("sentence")))
    if "words" in wanted:
        out = out.withColumn("words", tokens.overlap_words(F.col("text")))
    if "counts" in wanted:
        out = out.withColumn("counts", tokens.term_counts(tokens.terms(F.col("text"))))
        out = out.withColumn("squares", tokens.square_sum(F.col("counts")))
    return out.select("filestem", "file", "ord", *keep, *wanted), wanted


def shared(a: str, b: str) -> Column:
    """Number of elements in both arrays (of distinct elements)."""
    return F.size(F.array_intersect(a, b))


def overlap_ratio(n1: Column, n2: Column, both: Column) -> Column:
    """Common words over all words; 0 where there are none."""
    union = n1 + n2 - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def rouge_f(both: Column, n1: Column, n2: Column) -> Column:
    """ROUGE F-score from a match count and the two totals; 0 for empty texts."""
    p, r = both / n1, both / n2
    score = F.lit(2.0) * (p * r) / (p + r + F.lit(ROUGE_EPSILON))
    return F.when((n1 > 0) & (n2 > 0), score).otherwise(F.lit(0.0))


def indel_ratio(lcs: Column, n1: Column, n2: Column) -> Column:
    """Similarity from insertions and deletions only; 1 for two empty texts."""
    return F.when(n1 + n2 > 0, F.lit(2.0) * lcs / (n1 + n2)).otherwise(F.lit(1.0))


def term_products(counts1: str, counts2: str) -> Column:
    """Over the shared terms: sum of products and of both squares."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("dot"), zero.alias("s1"), zero.alias("s2"))

    def add(acc: Column, pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(
            a.isNotNull() & b.isNotNull(),
            F.struct(
                (acc["dot"] + a * b).alias("dot"),
                (acc["s1"] + a * a).alias("s1"),
                (acc["s2"] + b * b).alias("s2"),
            ),
        ).otherwise(acc)

    matched = F.map_zip_with(
        counts1, counts2, lambda _, a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    return F.aggregate(F.map_values(matched), start, add)


def cosine(products: Column, q1: Column, q2: Column) -> Column:
    """TF-IDF cosine of two texts whose vocabulary is those two texts.

    With K the inverse document frequency of a term in one text only, each norm
    is K^2 times the squares of its own terms plus the squares of the shared.
    """
    k2 = F.lit(IDF_ONE_OF_TWO**2)
    norm1 = F.sqrt(k2 * (q1 - products["s1"]) + products["s1"])
    norm2 = F.sqrt(k2 * (q2 - products["s2"]) + products["s2"])
    return F.when((q1 > 0) & (q2 > 0), products["dot"] / (norm1 * norm2)).otherwise(F.lit(0.0))


def _compare(
    pairs: DataFrame,
    metrics: Sequence[str],
    with_word_stats: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Scores of feature pairs.

    The first projection counts and lets go of the sets, so that only numbers and
    the texts of the sequence metrics go by the Python workers; the second makes
    the scores.
    """
    keep = [*PAIR_KEY, *keep]
    counted: list[Column] = []
    texts: list[str] = []
    if "word_overlap" in metrics:
        counted += [
            F.size("words1").alias("_w1"),
            F.size("words2").alias("_w2"),
            shared("words1", "words2").alias("_w"),
        ]
    if "cosine" in metrics:
        counted += [
            term_products("counts1", "counts2").alias("_t"),
            F.col("squares1").alias("_q1"),
            F.col("squares2").alias("_q2"),
        ]
    if "rouge-1" in metrics or UNION_ROUGE_L in metrics:
        counted += [F.size("unigrams1").alias("_u1"), F.size("unigrams2").alias("_u2")]
    if "rouge-1" in metrics:
        counted.append(shared("unigrams1", "unigrams2").alias("_u"))
    if UNION_ROUGE_L in metrics:
        texts += ["sentences1", "sentences2"]
    if "rouge-2" in metrics:
        counted += [
            F.size("bigrams1").alias("_b1"),
            F.size("bigrams2").alias("_b2"),
            shared("bigrams1", "bigrams2").alias("_b"),
        ]
    if "levenshtein" in metrics:
        counted += [F.length("text1").alias("_n1"), F.length("text2").alias("_n2")]
        texts += ["text1", "text2"]
    if "rouge-l" in metrics:
        counted += [F.col("word_count1").alias("_l1"), F.col("word_count2").alias("_l2")]
        texts += ["sentence1", "sentence2"]
    c = F.col

    def common(of, name: str, if_equal: str) -> Column:
        return F.coalesce(of(c(f"{name}1"), c(f"{name}2")), c(if_equal))

    scores = {
        "word_overlap": lambda: overlap_ratio(c("_w1"), c("_w2"), c("_w")),
        "levenshtein": lambda: indel_ratio(
            common(sequences.lcs_chars, "text", "_n1"), c("_n1"), c("_n2")
        ),
        "cosine": lambda: cosine(c("_t"), c("_q1"), c("_q2")),
        "rouge-1": lambda: rouge_f(c("_u"), c("_u1"), c("_u2")),
        # one-word texts have no bigram: the score is 0, as with no match
        "rouge-2": lambda: rouge_f(c("_b"), c("_b1"), c("_b2")),
        "rouge-l": lambda: rouge_f(
            common(sequences.lcs_words, "sentence", "_l1"), c("_l1"), c("_l2")
        ),
        UNION_ROUGE_L: lambda: rouge_f(
            common(sequences.lcs_sentences, "sentences", "_u1"), c("_u1"), c("_u2")
        ),
    }
    stats = [
        c("_w1").alias("words_1"),
        c("_w2").alias("words_2"),
        c("_w").alias("common"),
        (c("_w1") - c("_w")).alias("only_1"),
        (c("_w2") - c("_w")).alias("only_2"),
    ]
    return pairs.select(*keep, *counted, *texts).select(
        *keep,
        *[scores[m]().alias(column_of(m)) for m in metrics],
        *(stats if with_word_stats else []),
    )


def evaluate_pairs(
    variants: DataFrame,
    metrics: Sequence[str] = METRICS,
    with_word_stats: bool = False,
    tile: int | None = None,
) -> DataFrame:
    """One row per pair of variants of a document with a column per metric.

    Whole texts are compared. ``with_word_stats`` adds the word counts behind
    ``word_overlap``. With ``tile``, pairs are formed by ``tiled_pairs``: for tables that may have documents of
    very many variants.
    """
    featured, carry = with_features(variants, metrics)
    pairs = tiled_pairs(featured, carry, tile) if tile else variant_pairs(featured, carry)
    return _compare(pairs, metrics, with_word_stats)


def evaluate_checked(
    variants: DataFrame, checked: DataFrame | None = None, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Scores of the checked variant of each document (``filestem, file``; the
    first one where none are named) with the others: n - 1 pairs for n variants.

    The checked variant's features are given to the other rows of its document by
    a window, so the texts are shuffled once and joined with nothing. The column
    ``checked`` has its name.
    """
    document = Window.partitionBy("filestem")
    marked = variants
    if checked is not None:
        named = checked.select("filestem", F.col("file").alias("checked"))
        marked = variants.join(named, "filestem")
    featured, carry = with_features(marked, metrics, [] if checked is None else ["checked"])
    if checked is None:
        first = F.min(F.struct("ord", "file")).over(document)["file"]
        featured = featured.withColumn("checked", first)
    is_checked = F.col("file") == F.col("checked")
    taken = F.first(F.when(is_checked, F.struct("file", "ord", *carry)), ignorenulls=True)
    pairs = (
        featured.withColumn("_taken", taken.over(document))
        .where(~is_checked & F.col("_taken").isNotNull())
        .select(
            "filestem",
            "checked",
            *[F.col(f"_taken.{c}").alias(f"{c}1") for c in ("file", "ord", *carry)],
            *[F.col(c).alias(f"{c}2") for c in ("file", "ord", *carry)],
        )
    )
    return _compare(pairs.select("filestem", "checked", *turned(carry)), metrics, keep=["checked"])


def evaluate_against(
    fresh: DataFrame,
    stored: DataFrame,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Scores of new variants among themselves and against stored ones."""
    new, carry = with_features(fresh, metrics)
    old, _ = with_features(stored, metrics)
    pairs = variant_pairs(new, carry).unionByName(variant_pairs(new, carry, others=old))
    return _compare(pairs, metrics)


def word_stats(variants: DataFrame) -> DataFrame:
    """Word counts per pair: of each side, common, and of one side only."""
    return evaluate_pairs(variants, ["word_overlap"], with_word_stats=True).drop("word_overlap")


def word_differences(variants: DataFrame) -> DataFrame:
    """Sorted words that only one side of the pair has."""
    featured, carry = with_features(variants, ["word_overlap"])
    return variant_pairs(featured, carry).select(
        *PAIR_KEY,
        F.sort_array(F.array_except("words1", "words2")).alias("only_in_1"),
        F.sort_array(F.array_except("words2", "words1")).alias("only_in_2"),
    )


def levenshtein_distance(variants: DataFrame) -> DataFrame:
    """Unit-cost edit distance of each pair, over whole texts."""
    return variant_pairs(variants, ["text"]).select(
        *PAIR_KEY,
        sequences.levenshtein_distance(F.col("text1"), F.col("text2")).alias("distance"),
    )
