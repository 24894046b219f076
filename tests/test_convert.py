"""Pages, converters, assembly and rendering."""

import pytest
from pyspark.sql import functions as F

from folioscore.operators import convert, render
from folioscore.plans import tables
from folioscore.schemas import CHUNKS, ELEMENTS, LAYOUT_BLOCKS, PAGE_RESULTS, UNITS

pytestmark = pytest.mark.unit


def docs_of(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_split_and_count(spark):
    docs = docs_of(
        spark,
        "###### Page 1\n\nfirst\n\n###### Page 2\n\nsecond ###### Page 9\n",
        "intro\n\n###### Page 1\nbody",
        "no marker",
        "",
        " \n###### Page 4\n\n###### Page 5\n",
    )
    rows = convert.split_pages(docs).orderBy("doc_id", "page_no").collect()
    assert [(r["doc_id"], r["page_no"], r["page_text"]) for r in rows] == [
        ("d0", 1, "first"),
        ("d0", 2, "second ###### Page 9"),
        ("d1", 1, "intro"),
        ("d1", 2, "body"),
        ("d2", 1, "no marker"),
        ("d3", 1, ""),
        ("d4", 1, ""),
        ("d4", 2, ""),
    ]
    assert [r["pages"] for r in convert.page_count(docs).orderBy("doc_id").collect()] == [2, 2, 1, 1, 2]


def test_plan_units(spark):
    two = "###### Page 1\na\n###### Page 2\nb"
    rows = [(p, p, t) for p, t in [("openai", two), ("mistral", two), ("huggingface", "one")]]
    docs = spark.createDataFrame(rows, "doc_id string, parser string, text string")

    def units(split):
        got = convert.plan_units(docs, split).collect()
        return sorted((r["doc_id"], r["page_no"], r["unit_text"]) for r in got)

    assert units(True) == [
        ("huggingface", 1, "one"),
        ("mistral", 0, two),
        ("openai", 1, "a"),
        ("openai", 2, "b"),
    ]
    assert units(False)[-1] == ("openai", 0, two)
    assert units(None) == units(True)
    assert convert.retry_for("googleai", (OSError,)).attempts == 3
    assert convert.retry_for("openai", (OSError,)).attempts == 1


def test_converter_retries_and_quarantine(spark):
    def fn(text, attempt):
        if text == "slow" and attempt < 3:
            raise TimeoutError("busy")
        if text == "never":
            raise TimeoutError("busy")
        if text == "bad":
            raise ValueError("broken")
        return text.upper()

    units = spark.createDataFrame(
        [("a", 1, "ok"), ("a", 2, "slow"), ("b", 1, "never"), ("b", 2, "bad"), ("b", 3, "x")], UNITS
    )
    retry = convert.Retry(transient=(TimeoutError,), sleep=lambda s: None)
    results = convert.convert_units(units, fn, retry, concurrency=3)
    got = {(r["doc_id"], r["page_no"]): (r["markdown"], r["status"], r["error"], r["attempts"]) for r in results.collect()}
    assert got == {
        ("a", 1): ("OK", "ok", None, 1),
        ("a", 2): ("SLOW", "ok", None, 3),
        ("b", 1): (None, "error", "busy", 3),
        ("b", 2): (None, "error", "broken", 1),
        ("b", 3): ("X", "ok", None, 1),
    }
    status = {r["doc_id"]: r for r in convert.document_status(results).collect()}
    assert status["a"]["status"] == "ok" and status["b"]["status"] == "quarantined"
    assert (status["b"]["failed"], status["b"]["first_failed_page"], status["b"]["first_error"]) == (2, 1, "busy")
    assert [tuple(r) for r in convert.assemble_good(results).collect()] == [("a", "OK\n\nSLOW\n\n")]
    assert [retry.wait(n) for n in (1, 2, 3, 4, 5)] == [4.0, 4.0, 4.0, 8.0, 15.0]


def test_empty_answers(spark):
    rows = [
        ("d", 1, "openai", "", "ok", None),
        ("d", 2, "ollama", None, "ok", None),
        ("d", 3, "unstructuredio", None, "ok", None),
        ("d", 4, "anthropic", "", "ok", None),
        ("d", 5, "openai", None, "error", "earlier"),
    ]
    df = spark.createDataFrame(
        rows, "doc_id string, page_no int, parser string, markdown string, status string, error string"
    )
    got = convert.check_responses(df).orderBy("page_no").select("markdown", "status", "error").collect()
    assert [tuple(r) for r in got] == [
        ("", "error", "Empty response from openai"),
        (None, "error", "Empty response from ollama"),
        ("", "warning", None),
        ("", "ok", None),
        (None, "error", "earlier"),
    ]
    with pytest.raises(Exception, match="Empty response from"):
        convert.check_responses(df.where("page_no < 3"), fail=True).collect()


def test_assembly(spark):
    results = spark.createDataFrame(
        [("d", n, f"p{n}", "ok", None, 1) for n in (10, 2, 1)] + [("e", 1, "only", "ok", None, 1)], PAGE_RESULTS
    )
    ended = {r[0]: r[1] for r in convert.assemble_pages(results).collect()}
    joined = {r[0]: r[1] for r in convert.assemble_pages(results, "joined").collect()}
    assert ended == {"d": "p1\n\np2\n\np10\n\n", "e": "only\n\n"}
    assert joined == {"d": "p1\n\np2\n\np10", "e": "only"}
    with pytest.raises(ValueError):
        convert.assemble_pages(results, "other")
    chunks = spark.createDataFrame(
        [("d", 1, 2, "c"), ("d", 1, 0, "a"), ("d", 1, 1, None), ("d", 2, 0, None)], CHUNKS
    )
    got = {r["page_no"]: r["markdown"] for r in convert.assemble_chunks(chunks).collect()}
    assert got == {1: "ac", 2: ""}


def test_elements_to_html(spark):
    rows = [
        ("d", 2, "Table", "t", {"text_as_html": "<table>2</table>"}),
        ("d", 1, "Text", "plain", {"languages": "eng"}),
        ("d", 0, "Table", "t", {"text_as_html": "<table>0</table>"}),
        ("e", 0, "Text", "plain", {}),
    ]
    got = {r[0]: r[1] for r in render.elements_to_html(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert got["d"] == render.HTML_HEAD + "<table>0</table>\n<table>2</table>\n" + render.HTML_TAIL
    assert got["e"] == render.HTML_HEAD + render.HTML_TAIL


def test_html_to_markdown(spark):
    html = (
        "<!DOCTYPE html><html><head><title>t</title></head><body><!-- x --><h2 class='a'> Head </h2>"
        "<p>One <b>bold</b> <em>it</em> <a class='k' href=\"u\">link</a><br/>two &amp;lt; &lt;x&gt;</p>"
        "<ul><li>a</li><li>b</li></ul>"
        "<table><tr><th>H</th><th>I</th></tr>\n<tr><td>1</td><td>2</td></tr></table>"
        "<script>var a;</script></body></html>"
    )
    df = spark.createDataFrame([(html,)], "html string")
    got = df.select(render.html_to_markdown("html")).first()[0]
    assert got.startswith("## Head\n\nOne **bold** *it* [link](u)\ntwo &lt; <x>\n\n* a\n* b\n\n")
    assert "| H | I |" in got and "| 1 | 2 |" in got and "var a" not in got


def test_linearize_layout(spark):
    def cells(seq, row, *texts, kind="table"):
        return [("d", 1, seq, kind, row, i, t) for i, t in enumerate(texts, 1)]

    rows = [
        ("d", 1, 1, "title", 0, 0, "Name"),
        ("d", 1, 2, "figure", 0, 0, "logo"),
        ("d", 1, 3, "section_header", 0, 0, "Part"),
        *cells(4, 0, "h1", "h2", kind="column_header"),
        *cells(4, 2, "c", "d"),
        *cells(4, 1, "a", "b"),
        ("d", 1, 4, "table", 3, 1, "wide"),
        ("d", 1, 4, "merged", 3, 2, "wide"),
        ("d", 1, 4, "column_header", 4, 1, "sub"),
        ("d", 1, 4, "table", 4, 2, "kept"),
        ("d", 1, 5, "text", 0, 0, "end"),
        ("d", 2, 1, "text", 0, 0, "second page"),
    ]
    df = spark.createDataFrame(rows, LAYOUT_BLOCKS).orderBy(F.rand(1))
    got = {r["page_no"]: r["page_text"] for r in render.linearize_layout(df).collect()}
    assert got == {
        1: "# Name\n\n## Part\n\n| a | b |\n| c | d |\n| wide |  |\n| sub | kept |\n\nend",
        2: "second page",
    }


def test_linearize_layout_of_odd_blocks(spark):
    rows = [
        # missing texts are left out, a missing place is a place, parts of one place are joined
        ("d", 1, 1, "text", 0, 1, None),
        ("d", 1, 2, "text", 0, 2, "b"),
        ("d", 1, 2, "text", 0, 1, "a"),
        ("d", 1, 2, "text", 0, 3, None),
        ("d", 1, 2, "text", 0, 3, "c"),
        ("d", 1, 2, "text", 1, 1, "d"),
        ("d", 1, None, "text", 1, 1, "n1"),
        ("d", 1, None, "text", 2, 1, "n2"),
        ("d", 1, None, "table", 2, 1, None),
        # a table row and a text at one place, by their lines; merged cells are empty
        ("e", 1, 1, "table", 0, 1, "x"),
        ("e", 1, 1, "text", 0, 1, "A"),
        ("e", 1, 2, "text", 0, 1, "~"),
        ("e", 1, 2, "table", 0, 2, "y"),
        ("e", 1, 2, "merged", 0, 3, None),
        ("e", 1, 3, "text", None, 1, "~"),
        ("e", 1, 3, "column_header", None, 1, "left out"),
        ("e", 1, 3, "text", 4, 1, "z"),
        # pages of figures or headers only are none; missing keys are keys; a missing kind is left out
        ("f", 1, 1, "figure", 0, 0, "logo"),
        ("f", 2, 1, "column_header", 0, 0, "h"),
        (None, None, 1, "title", 0, 0, "no key"),
        (None, None, 1, None, 0, 0, "no kind"),
        (None, 1, 1, "section_header", 0, 0, None),
    ]
    rows += [("g", 1, 1, "table", i, j, f"{i}-{j}") for i in range(40) for j in range(2)] * 2
    wanted = {
        ("d", 1): "n1\n\nn2\n\n|  |\n\n\n\na | b | c\nd",
        ("e", 1): "A\n| x |\n\n| y |  |\n~\n\n~\nz",
        (None, None): "# no key",
        (None, 1): "",
        ("g", 1): "\n".join(f"| {i}-0 | {i}-0 | {i}-1 | {i}-1 |" for i in range(40)),
    }
    df = spark.createDataFrame(rows, LAYOUT_BLOCKS).orderBy(F.rand(2))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(size)
    try:
        for n in ("1", "3", "1000"):  # pages that end within, at and after a batch
            spark.conf.set(size, n)
            got = render.linearize_layout(df).collect()
            assert {(r["doc_id"], r["page_no"]): r["page_text"] for r in got} == wanted and len(got) == len(wanted)
    finally:
        spark.conf.set(size, given)
    assert render.linearize_layout(df.limit(0)).collect() == []


def test_linearize_layout_sorts_once_and_its_blocks_are_not_shuffled(spark, tiny):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    alone = plan(render.linearize_layout(spark.createDataFrame([], LAYOUT_BLOCKS)))
    assert alone.count("Exchange") == 1 and alone.count("Sort ") == 1 and "Aggregate" not in alone
    dealt = plan(render.linearize_layout(spark.createDataFrame([], LAYOUT_BLOCKS).repartition("doc_id")))
    assert dealt.count("Exchange") == 1
    # what is dealt out by page are lines and heads: no exchange is above the two places that make blocks
    query = plan(render.linearize_layout(tables.layout_blocks(spark, tiny)))
    before, cells, heads = query.split("Generate inline")
    assert "Exchange" not in before and "Aggregate" not in before
    assert cells.count("Exchange") == 1 and "Sort" not in cells.split("Union")[0]


@pytest.mark.unit
def test_missing_page_text_keeps_its_place(spark):
    rows = [("d", 1, "a", "ok"), ("d", 2, None, "ok"), ("d", 3, "c", "ok")]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, markdown string, status string")
    for made in (convert.assemble_pages(df), convert.assemble_good(df)):
        assert made.first()["markdown"] == "a\n\n\n\nc\n\n"
    assert convert.assemble_pages(df, "joined").first()["markdown"] == "a\n\n\n\nc"
