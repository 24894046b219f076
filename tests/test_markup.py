"""HTML by a stack of open tags: results written by hand."""

import pytest
from pyspark.sql import functions as F

from folioscore.operators.markup import html_to_markdown_nested

pytestmark = pytest.mark.unit
CASES = [
    ("<p>one</p><p>two</p>", "one\n\ntwo"),
    ("<h2> Title </h2>text", "## Title\n\ntext"),
    # nested and overlapping emphasis
    ("<b>bold <i>both</i></b> <em>it</em>", "**bold *both*** *it*"),
    ("<b>a <strong>b</strong> c</b>", "**a **b** c**"),
    ("<b>one <i>two</b> three</i>", "**one two** three"),
    # tags that are not closed, closed twice, or cut off by their block, leave no mark
    ("<p><b>open</p><p>next</p>", "open\n\nnext"),
    ("<b>never closed", "never closed"),
    ("x</b> y</i>", "x y"),
    ("<p><b>a</p><p>b</b></p>", "a\n\nb"),
    ("<b></b><i> </i>x", "x"),
    # links
    ('<a href="https://x.org/?a=1">go <b>on</b></a>', "[go **on**](https://x.org/?a=1)"),
    ("<a class='l' href='u'>a</a> <a name='n'>b</a> <a href=\"v\">c", "[a](u) b c"),
    # lists within lists, ordered ones numbered each by its own
    ("<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>", "* a\n    * b\n    * c\n* d"),
    ("<ol><li>a</li><li>b<ol><li>x</li><li>y</li></ol></li><li>c</li></ol>", "1. a\n2. b\n    1. x\n    2. y\n3. c"),
    ("<ul><li>a<ol><li>x<ul><li>deep</li></ul></li></ol></li></ul>after", "* a\n    1. x\n        * deep\n\nafter"),
    ("<ol><li>one<li>two</ol>", "1. one\n2. two"),
    ("<li>alone</li>", "* alone"),
    ("<ul><li><b>open</li><li>b</li></ul>", "* open\n* b"),
    # tables, breaks, hidden parts, entities, signs that begin no tag
    ("<table><tr><th>A</th><th>B</th></tr>\n<tr><td>1</td> <td>2</td></tr></table>", "| A | B |\n| 1 | 2 |"),
    ("one<br>two<BR/>three", "one\ntwo\nthree"),
    ("<!-- <p>x</p> --><head><title>t</title></head>a<SCRIPT>if (a < b) {}</SCRIPT>b<style>p {}</style>c", "abc"),
    ("&lt;b&gt; a&nbsp;b &amp;lt; &copy;", "<b> a b &lt; ©"),
    ("1 < 2 and 3 > 2, a <3", "1 < 2 and 3 > 2, a <3"),
    ("a \n\t b<span>c</span> <img src='x'> d", "a bc d"),
    ("", ""),
    (" \n ", ""),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, html string")
    got = [r[1] for r in df.select("i", html_to_markdown_nested("html")).orderBy("i").collect()]
    assert [(c[0], c[1], g) for c, g in zip(CASES, got) if g != c[1]] == []
    none = spark.createDataFrame([(None,)], "html string")
    assert none.select(html_to_markdown_nested("html")).first()[0] is None


def test_given_pages_have_no_lone_marks(spark, tiny):
    """Pages whose ``<b>`` is left open: the marks that are left stand in pairs around a text."""
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html", html_to_markdown_nested("html").alias("md"))
    rows = pages.withColumn("broken", F.regexp_count("html", F.lit("<b>")) > F.regexp_count("html", F.lit("</b>"))).collect()
    assert any(r["broken"] for r in rows)
    for r in rows:
        closed = r["html"].count("</b>") + r["html"].count("</strong>")
        assert r["md"].count("**") <= 2 * closed and r["md"].count("**") % 2 == 0 or "**" in r["html"], r["page_id"]
