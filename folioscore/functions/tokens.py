"""Token columns. All are built-in expressions evaluated once per text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscore.functions.columns import let

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
WHITESPACE_OR_STOP = r"(?U)[.\s\x1c-\x1f]+"
# Fixed value: runs of at least two word characters.
TERM = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    """Lower-cased terms of at least two word characters, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def overlap_words(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), WHITESPACE), ""))


def rouge_text(text: Column) -> Column:
    """Words of all sentences in order, one space between them, case kept."""
    return F.trim(F.regexp_replace(text, WHITESPACE_OR_STOP, " "))


def rouge_words(rouge: Column) -> Column:
    """Word sequence of a ``rouge_text`` column."""
    return F.array_remove(F.split(rouge, " "), "")


def rouge_sentences(text: Column) -> Column:
    """Sentences with a stop between them, one space between words."""
    spaced = F.regexp_replace(text, WHITESPACE, " ")
    joined = F.regexp_replace(spaced, r" ?\.[ .]*", ".")
    return F.regexp_replace(joined, r"^[ .]+|[ .]+$", "")


def rouge_unigrams(rouge: Column) -> Column:
    return F.array_distinct(rouge_words(rouge))


def rouge_bigrams(rouge: Column) -> Column:
    """Distinct neighbouring word pairs (a space cannot occur in a word)."""

    def pairs(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(
            F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)
        )

    return F.array_distinct(let(rouge_words(rouge), pairs))


def term_counts(tokens: Column) -> Column:
    """Map term -> count of one text, without exploding it into rows.

    The sorted terms are cut at the ends of their runs, so the work is one sort
    and two linear passes inside the row.
    """

    def by_run(s: Column) -> Column:
        ends = F.when(
            F.size(s) > 0,
            F.filter(
                F.sequence(F.lit(1), F.size(s)),
                lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)),
            ),
        ).otherwise(F.array().cast("array<int>"))
        return let(
            ends,
            lambda e: F.map_from_arrays(
                F.transform(e, lambda i: F.get(s, i - 1)),
                F.transform(
                    e, lambda i, k: (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long")
                ),
            ),
        )

    return let(F.sort_array(tokens), by_run)


def square_sum(counts: Column) -> Column:
    """Sum of the squared counts of a ``term_counts`` map."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda acc, n: acc + n * n)
