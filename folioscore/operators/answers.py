"""Answers as the services send them, taken apart by parser.

An answer is one JSON text per unit. Each parser has its own path to the text in it:

* ``openai``: ``choices[0].message.content``; no choices and empty content are errors of their own;
* ``huggingface``: an array of stream chunks, ``choices[0].delta.content`` of each, null ones empty;
* ``anthropic``: ``content[0].text``; no content is an error, an empty text is not;
* ``googleai`` and ``textract``: ``text``, which has to be there;
* ``mistral``: ``pages[*].markdown``, a blank line between pages, none where there are no pages;
* ``ollama``: ``message.content``, which must not be empty;
* ``unstructuredio``: ``elements``; those with HTML become a page and then Markdown, null elements are an
  empty text and a warning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscore.operators.render import HTML_HEAD, HTML_TAIL, html_to_markdown

VERDICTS = ("ok", "unreadable", "no answer", "empty")


def _get(answer: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(answer, path, kind)


def extract_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``(…, parser, answer)`` with ``markdown, verdict, status, error`` in place of the answer.

    Verdicts: ``unreadable`` (no JSON, or no path of the parser's in it), ``no answer`` (no choices, content,
    message or elements), ``empty``, or ``ok``. ``status`` is ``warning`` for null elements, ``error`` for what
    the parser does not take, and else ``ok``. An unknown parser's answers are unreadable, and so is a
    JSON text with a string above Spark's JSON limit (20 million characters): it is told, not dropped.
    """
    read = answers.withColumn("_v", F.try_parse_json(answer))
    v, parser = F.col("_v"), F.col("parser")
    pages = _get(v, "$.pages", "array<struct<markdown:string>>")
    chunks = _get(v, "$", "array<struct<choices:array<struct<delta:struct<content:string>>>>>")
    elements = _get(v, "$.elements", "array<struct<metadata:struct<text_as_html:string>>>")
    html = F.transform(
        F.filter(elements, lambda e: e["metadata"]["text_as_html"].isNotNull()),
        lambda e: F.concat(e["metadata"]["text_as_html"], F.lit("\n")),
    )
    page = F.concat(F.lit(HTML_HEAD), F.array_join(html, ""), F.lit(HTML_TAIL))
    deltas = F.transform(chunks, lambda c: F.coalesce(F.get(c["choices"], 0)["delta"]["content"], F.lit("")))
    texts = {
        "openai": _get(v, "$.choices[0].message.content"),
        "huggingface": F.array_join(deltas, ""),
        "anthropic": _get(v, "$.content[0].text"),
        "googleai": _get(v, "$.text"),
        "textract": _get(v, "$.text"),
        "mistral": F.array_join(F.transform(pages, lambda p: F.coalesce(p["markdown"], F.lit(""))), "\n\n"),
        "ollama": _get(v, "$.message.content"),
        "unstructuredio": F.coalesce(html_to_markdown(page), F.lit("")),
    }
    #: what has to be in an answer of the parser, whatever it holds
    known = {
        "openai": "$.choices",
        "huggingface": "$[0]",
        "anthropic": "$.content",
        "googleai": "$.text",
        "textract": "$.text",
        "mistral": "$.pages",
        "ollama": "$.message",
        "unstructuredio": "$.elements",
    }
    lacking = {
        "openai": F.coalesce(F.size(_get(v, "$.choices", "array<variant>")), F.lit(0)) <= 0,
        "anthropic": F.coalesce(F.size(_get(v, "$.content", "array<variant>")), F.lit(0)) <= 0,
        "googleai": texts["googleai"].isNull(),
        "textract": texts["textract"].isNull(),
        "ollama": _get(v, "$.message", "variant").isNull() | F.is_variant_null(_get(v, "$.message", "variant")),
        "unstructuredio": elements.isNull(),
    }

    def of(parts: dict, otherwise: Column) -> Column:
        out = otherwise
        for name, part in parts.items():
            out = F.when(parser == name, part).otherwise(out)
        return out

    there = of({p: _get(v, path, "variant").isNotNull() for p, path in known.items()}, F.lit(False))
    # an empty stream has no chunk, and is an empty text
    there = there | ((parser == "huggingface") & (F.coalesce(F.size(chunks), F.lit(-1)) == 0))
    no_answer = of(lacking, F.lit(False))
    text = of(texts, F.lit(None).cast("string"))
    refuses = parser.isin("openai", "ollama")
    empty = F.coalesce(text, F.lit("")) == ""
    verdict = (
        F.when(v.isNull() | ~there, "unreadable").when(no_answer, "no answer").when(empty, "empty").otherwise("ok")
    )
    given = [F.col(f"`{c}`") for c in answers.columns if c not in (answer, "markdown", "verdict", "status", "error")]
    judged = read.select(*given, text.alias("markdown"), verdict.alias("verdict"))
    tolerated = (parser == "unstructuredio") & (F.col("verdict") == "no answer")
    status = (
        F.when(tolerated, "warning")
        .when(F.col("verdict").isin("unreadable", "no answer") | ((F.col("verdict") == "empty") & refuses), "error")
        .otherwise("ok")
    )
    error = (
        F.when(F.col("verdict") == "unreadable", F.concat(F.lit("Unreadable response from "), parser))
        .when(F.col("verdict") == "no answer", F.concat(F.lit("No answer in the response from "), parser))
        .otherwise(F.concat(F.lit("Empty response from "), parser))
    )
    return judged.select(*given, "markdown", "verdict", status.alias("status")).select(
        *given,
        F.when(F.col("status") == "error", None).otherwise(F.coalesce("markdown", F.lit(""))).alias("markdown"),
        "verdict",
        "status",
        F.when(F.col("status") != "ok", error).alias("error"),
    )
