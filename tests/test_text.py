"""Markdown stripping, tokens and sequence kernels."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscore.functions import normalize, sequences, tokens
from tests import brute

pytestmark = pytest.mark.unit

MARKDOWN = r"""
## Visit report

We **liked** the __garden__; the *path* was _wet_.

* ~~apples~~
* `pears`

3. first stop
4. second stop

> They said so

[Map](https://example.org/map) of the area:

| Plant | Height |
|:------|-------:|
| Fern  | 20     |
| Moss  | 2      |

The sum $$a + b$$ and $c$ are left out, as is \(x\) and \alpha here &nbsp; too.

***
kept line
17
last line
"""
# Written by hand from the rules: the separator row takes the line end between the
# head and the first row of the table with it.
PLAIN = (
    "Visit report We liked the garden the path was wet apples pears first stop second stop "
    "They said so Map of the area Plant HeightFern 20 Moss 2 "
    "The sum and are left out as is and here too kept line last line"
)

ADVERSARIAL = [
    "",
    "   \n\t ",
    "12\n\n34\ntext",
    "a\nTable of Contents\nb",
    "a\ntable of contents\nb",
    "costs $5 and $6 today",
    "snake_case_name and __dunder__ and *a\nb*",
    "\\pivot \\alpha\\beta \\Gamma \\omicron \\infty \\int_0^1 \\sum \\text{ab} \\frac{a}{b}{c}",
    "\\(x+y\\) and \\[ z \\] and \\mathrm{d}x \\sqrt{2}\\\nnext",
    "| a | b |c\n|--|:-:|\n| d || e |\n|f|\n|  | g |",
    "x² and a b c\x1cd é ١٢. item",
    "a\r\nb\r\n- c\r\n",
    "&amp; &copy; &#39; \\& \\% \\_",
    "![alt](img.png) [a](b)(c) [x]: y",
    "####### seven\n#no space\n#\n\n\nnext",
    "> quote\n>> nested\n>tight",
    "***\n---\n___\n- - -\n--",
    "<br>one<br/>two",
    "###### Page 3\n\n*(continued)*\n\n[^1]: note",
    "~~gone~~ `code` ```\nblock\n```",
    "\x85a\x85\x85b\x0bc\x0cd",
    "ends with newline\n",
]


def test_strip_golden(spark):
    df = spark.createDataFrame([(MARKDOWN,)], "t string")
    got = df.select(normalize.strip_markdown("t")).first()[0]
    assert got == PLAIN


def test_strip_equals_python_on_adversarial_text(spark):
    rows = [(i, t) for i, t in enumerate(ADVERSARIAL)]
    rng = random.Random(7)
    alphabet = list("#*_~`[]()-1.>|:<br>$\\{}&; \n\t") + ["ab", "é", "\\alpha", "&x;", "²", " "]
    rows += [(len(rows) + k, "".join(rng.choices(alphabet, k=40))) for k in range(400)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = dict(df.select("i", normalize.strip_markdown("t")).collect())
    wrong = [(t, got[i], brute.strip(t)) for i, t in rows if got[i] != brute.strip(t)]
    assert not wrong


def test_maybe_strip_and_truncate(spark):
    df = spark.createDataFrame([("**a** é😀z",)], "t string")
    row = df.select(
        normalize.maybe_strip("t", False).alias("raw"),
        normalize.maybe_strip("t", True).alias("clean"),
        normalize.truncate_for_rouge("t", 8).alias("cut"),
        normalize.truncate_for_rouge("t", None).alias("whole"),
    ).first()
    assert row["raw"] == "**a** é😀z" and row["clean"] == "a é z"
    assert row["cut"] == "**a** é😀" and row["whole"] == row["raw"]


def test_tokens(spark):
    text = "One  two. two_2 x ².a Two\x1cé. end"
    df = spark.createDataFrame([(text,), ("",), (" . ",)], "t string")
    got = df.select(
        tokens.terms(F.col("t")),
        tokens.overlap_words(F.col("t")),
        tokens.rouge_words(tokens.rouge_text(F.col("t"))),
        tokens.rouge_bigrams(tokens.rouge_text(F.col("t"))),
        tokens.term_counts(tokens.terms(F.col("t"))),
    ).collect()
    assert got[0][0] == ["one", "two", "two_2", "two", "end"]
    assert sorted(got[0][1]) == sorted(set(text.lower().split()))
    assert got[0][2] == brute.rouge_words(text)
    assert len(got[0][3]) == len(got[0][2]) - 1
    assert got[0][4] == {"one": 1, "two": 2, "two_2": 1, "end": 1}
    for row in got[1:]:
        assert [len(x) for x in row][0] == 0 and row[4] == {} and row[3] == []


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=60), st.text("abcé", max_size=60))
def test_kernels_equal_tables(a, b):
    assert sequences.lcs_length(a, b) == brute.lcs(a, b)
    assert sequences.edit_distance(a, b) == brute.edits(a, b)


def test_kernels_on_long_and_word_input():
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefgh ", k=3000))
    b = "".join(rng.choices("abcdefgh ", k=2500))
    assert sequences.lcs_length(a, b) == brute.lcs(a, b)
    assert sequences.edit_distance(a, b) == brute.edits(a, b)
    x, y = a.split(), b.split()
    assert sequences.lcs_length(x, y) == brute.lcs(x, y)
    assert sequences.lcs_length(a, a[:1000] + a[1500:]) == 2500
    assert sequences.edit_distance("kitten", "sitting") == 3


def test_distance_column(spark):
    df = spark.createDataFrame(
        [("kitten", "sitting"), ("", "abc"), ("same", "same"), ("é", "e")], "a string, b string"
    )
    got = [r[0] for r in df.select(sequences.levenshtein_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [3, 3, 0, 1]
