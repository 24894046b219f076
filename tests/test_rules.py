"""Markdown and HTML rules against results written by hand, in both engines.

The rule tables of the library are not read here, so neither the queries nor their SQL can be right by agreeing
with each other only.
"""

import duckdb
import pytest

from folioscore.functions import normalize
from folioscore.operators import render
from folioscore.plans import oracle

pytestmark = pytest.mark.unit

# The page and the result that the file-by-file tool is known by.
KNOWN_PAGE = """
# Header 1
## Header 2

This is **bold** and *italic* text.

- List item 1
- List item 2

1. Numbered item 1
2. Numbered item 2

> Blockquote

```python
def test():
    pass
```

[Link](https://example.com)

| Header 1 | Header 2 |
|----------|----------|
| Cell 1   | Cell 2   |
| Cell 3   | Cell 4   |

$$E = mc^2$$

---
    """
KNOWN_RESULT = (
    "Header 1 Header 2 This is bold and italic text List item 1 List item 2 Numbered item 1 Numbered item 2 "
    "Blockquote python def test pass Link Header 1 Header 2Cell 1 Cell 2 Cell 3 Cell 4"
)

STRIPPED = [
    # headings, at the start of a line and before white space only
    ("# One", "One"),
    ("###### Six\n# One", "Six One"),
    ("a # b", "a b"),
    ("#tag", "tag"),
    # emphasis, in the order two stars, two lines, one star, one line; over line ends
    ("**a b** c", "a b c"),
    ("__a__ and *b* and _c_", "a and b and c"),
    ("***x***", "x"),
    ("snake_case_name", "snakecasename"),
    ("one_two", "one_two"),
    ("*a\nb*", "a b"),
    # code and strike-through keep their content
    ("~~gone~~ `code`", "gone code"),
    ("```\nblock\n```", "block"),
    # links keep their text, images their sign becomes a space
    ("see [the map](https://x.org/a_b) now", "see the map now"),
    ("![alt](img.png)", "alt"),
    ("[no link]", "no link"),
    # lists, quotes, rules
    ("- a\n- b", "a b"),
    ("* a\n\n\n* b", "a b"),
    ("10. ten\n2) two", "ten 2 two"),
    ("a - b", "a b"),
    ("> said", "said"),
    (">tight", "tight"),
    ("a\n---\nb", "a b"),
    ("a\n\n_____\n\nb", "a b"),
    ("a\n--\nb", "a b"),
    # tables: a row takes blank lines before it with it, as the separator leaves one
    ("| a | b |", "a b"),
    ("x\n| a | b |\ny", "x a b y"),
    ("| a |\n|---|\n| b |", "ab"),
    ("| a || b |", "a b"),
    ("a | b", "a b"),
    ("one<br>two", "one two"),
    # formulas
    ("x $$a\nb$$ y", "x y"),
    ("costs $5 and $6 today", "costs 6 today"),
    ("p \\(x+y\\) q \\[ z \\] r", "p q r"),
    ("\\(a\nb\\)", "a b"),
    # LaTeX commands; Greek letters end nowhere in particular
    ("\\mathrm{d}x \\text{ab} \\frac{a}{b}c \\sqrt{2}", "x c"),
    ("\\sum_i \\infty \\interior", "_i erior"),
    ("\\alpha\\beta x", "x"),
    ("\\pivot \\omicron", "vot"),
    ("\\Gamma \\other{a}", "a"),
    # entities and escapes
    ("a&nbsp;b &#39;", "ab 39"),
    ("\\% done \\& more", "done more"),
    # signs become spaces, letters of any script, digits and underscores stay
    ("a+b=c", "a b c"),
    ("naïve café x²", "naïve café x²"),
    ("日本 ١٢ x", "日本 ١٢ x"),
    # page numbers only where line ends are left: two or more blanks have become one space before
    ("12\nafter", "after"),
    ("before\n12\nafter", "before after"),
    ("before 12\nafter", "before 12 after"),
    ("Table of Contents\nafter", "after"),
    ("table of contents\nafter", "table of contents after"),
    # white space of every kind, at the ends none
    ("  a \t b\r\nc \u00a0 d\u2003e\x0bf\x1cg ", "a b c d e f g"),
    ("", ""),
    (" \n\t", ""),
]

HTML = [
    ("<p>one</p><p>two</p>", "one\n\ntwo"),
    ("<h1> Title </h1>text", "# Title\n\ntext"),
    ("a<h3 class='x'>Sub</h3>b", "a\n\n### Sub\n\nb"),
    ("<b>bold</b> <strong>strong</strong> <i>it</i> <em class=\"y\">em</em>", "**bold** **strong** *it* *em*"),
    ('<a class="l" href="https://x.org/?a=1">go <b>on</b></a>', "[go **on**](https://x.org/?a=1)"),
    ("<a name='x'>kept</a>", "kept"),
    ("one<br>two<br/>three<br />four", "one\ntwo\nthree\nfour"),
    ("<ul><li>a</li><li>b</li></ul>", "* a\n* b"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td> <td>2</td></tr></table>", "| A | B |\n| 1 | 2 |"),
    ("<!-- gone\n<p>x</p> -->a<script>if (a < b) {}</script>b<style>p {}</style>c", "abc"),
    ("<html><head><title>t</title></head><body>body</body></html>", "body"),
    ("<div><section>a</section><footer>b</footer></div>", "a\n\nb"),
    ("<span>a</span><img src='x'>b", "ab"),
    ("&lt;b&gt; &quot;q&quot; &#39;s&#39; a&nbsp;b &copy; &middot; &amp;lt;", "<b> \"q\" 's' a b © · &lt;"),
    ("a  \n<p>\n\n\n\nb</p>\n", "a\n\nb"),
    ("", ""),
    ("plain text", "plain text"),
]


def in_spark(spark, cases, make):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    return [r[1] for r in df.select("i", make("text")).orderBy("i").collect()]


def in_sql(cases, expression):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, text VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, c[0], c[0]) for i, c in enumerate(cases)])
    return [r[0] for r in con.execute(f"SELECT {expression} FROM t ORDER BY i").fetchall()]


def differing(cases, got):
    return [(c[0], c[1], g) for c, g in zip(cases, got) if g != c[1]]


def test_stripped_texts(spark):
    assert differing(STRIPPED, in_spark(spark, STRIPPED, normalize.strip_markdown)) == []


def test_stripped_texts_in_sql():
    assert differing(STRIPPED, in_sql(STRIPPED, oracle._strip("text"))) == []


def test_the_known_page(spark):
    case = [(KNOWN_PAGE, KNOWN_RESULT)]
    for got in (in_spark(spark, case, normalize.strip_markdown), in_sql(case, oracle._strip("text"))):
        assert " ".join(got[0].split()) == KNOWN_RESULT


def test_html(spark):
    assert differing(HTML, in_spark(spark, HTML, render.html_to_markdown)) == []


def test_html_in_sql():
    sql = oracle.ORACLE["html_to_markdown"]
    expression = sql[len("SELECT page_id, ") : sql.rindex(" AS markdown")]
    assert differing(HTML, in_sql(HTML, expression)) == []
