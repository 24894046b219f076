"""The given tables seen as variants, documents, pages, chunks, jobs, blocks.

Each view reads its whole table. A conversation is one *document*, its turns are
the variants, pages or responses of that document; the turn also picks the parser
that is said to have made it, round and round, and is part of the model's name, so
that files of one parser stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscore.operators.registry import PARSER_NAMES, PARSERS
from folioscore.session import spread
from folioscore.sources.naming import output_name

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts take work per row, spread over the cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def by_position(values: list[str], position: Column) -> Column:
    """Pick from a short fixed list by a 0-based position."""
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def turn_document(conv: str = "conv_id") -> Column:
    """Key of the document a turn belongs to."""
    return F.concat(F.lit("conv"), F.col(conv))


def turn_position(turn: str = "turn") -> Column:
    return F.col(turn).cast("int")


def turn_parser(position: Column) -> Column:
    """Place of the parser that a turn stands for."""
    return F.pmod(position, F.lit(len(PARSER_NAMES)))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the Markdown files that the parsers made of one document."""
    return variants_of(table(spark, sf_dir, "conversations"))


def variants_of(conversations: DataFrame) -> DataFrame:
    place = turn_parser(F.col("ord"))
    parser = by_position([p[0] for p in PARSERS], place)
    given = F.nullif(by_position([p[1] for p in PARSERS], place), F.lit(""))
    model = F.concat_ws("-", given, F.concat(F.lit("t"), F.col("ord")))
    return (
        conversations.select(
            turn_document().alias("filestem"), turn_position().alias("ord"), "text"
        )
        .withColumn("parser", parser)
        .withColumn("model", model)
        .withColumn("file", output_name(F.col("filestem"), F.col("parser"), F.col("model")))
        .select("filestem", "parser", "model", "file", "ord", "text")
    )


def dressed(text: Column, key: Column) -> Column:
    """A text put into Markdown: heading, emphasis, lists, table, quote, link,
    formula, entity, page number and rule around the whole text."""
    return F.concat(
        F.lit("# Title "), key, F.lit("\n\n**bold words** and *slanted* ~~gone~~ `code`\n\n"),
        F.lit("- first item\n- second_item_here\n\n1. one\n2. two\n\n> quoted line\n\n"),
        F.lit("[link "), key, F.lit("](https://example.com/a)\n\n"),
        F.lit("| Name | Value |\n|------|-------|\n| key | "), key, F.lit(" |\n\n"),
        text,
        F.lit("\n\n$$E = mc^2$$ and $x$ and \\(y\\) \\alpha\\frac{a}{b} \\pivot &amp; \\% done\n\n"),
        key, F.lit("\n\nTable of Contents\n\n---\n"),
    )


def dressed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", dressed(F.col("text"), F.col("doc_id").cast("string")).alias("text")
    )


def dressed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).withColumn(
        "text", dressed(F.col("text"), F.col("ord").cast("string"))
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the pages of documents."""
    return table(spark, sf_dir, "conversations").select(
        turn_document().alias("doc_id"),
        (turn_position() + 1).alias("page_no"),
        F.col("text").alias("page_text"),
    )


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page heading before each page."""
    page = F.struct(
        "page_no",
        F.concat(
            F.lit("###### Page "), F.col("page_no"), F.lit("\n\n"), F.col("page_text"), F.lit("\n\n")
        ).alias("t"),
    )
    return (
        pages(spark, sf_dir)
        .groupBy("doc_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(page)), lambda x: x["t"]), ""
            ).alias("text")
        )
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a turn as deltas of one response; blank lines are null deltas."""
    return chunks_of(text_table(spark, sf_dir, "conversations", "conv_id", "turn", "text"))


def chunks_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        turn_document().alias("doc_id"),
        (turn_position() + 1).alias("page_no"),
        F.posexplode(F.split("text", r"(?<=\.)")).alias("seq", "_d"),
    ).select("doc_id", "page_no", "seq", F.nullif(F.col("_d"), F.lit("")).alias("delta"))


def timed_chunks(conversations: DataFrame) -> DataFrame:
    """The same deltas with a mark at the last one of a response and a time of arrival."""
    deltas = F.split("text", r"(?<=\.)")
    return conversations.select(
        turn_document().alias("doc_id"),
        (turn_position() + 1).alias("page_no"),
        F.size(deltas).alias("_n"),
        F.posexplode(deltas).alias("seq", "_d"),
    ).select(
        "doc_id",
        "page_no",
        "seq",
        F.nullif(F.col("_d"), F.lit("")).alias("delta"),
        (F.col("seq") == F.col("_n") - 1).alias("is_last"),
        F.timestamp_seconds(F.col("page_no") * 60).alias("arrived"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph pieces of each page; pieces that open a paragraph carry HTML."""
    piece = F.posexplode(F.split("html", "</p>")).alias("seq", "text")
    return (
        text_table(spark, sf_dir, "pages", "page_id", "html")
        .select(F.col("page_id").cast("string").alias("doc_id"), piece)
        .select(
            "doc_id",
            "seq",
            F.lit("paragraph").alias("kind"),
            "text",
            F.when(
                F.contains("text", F.lit("<p>")),
                F.create_map(F.lit("text_as_html"), F.concat(F.col("text"), F.lit("</p>"))),
            )
            .otherwise(F.create_map(F.lit("languages"), F.lit("eng")))
            .alias("metadata"),
        )
    )


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order forms with a page per supplier: title, section, figure, table. Lines and heads are dealt out
    by page before they become blocks, so that blocks, which are many, need no shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_suppkey").cast("int").alias("page_no"),
        # line numbers repeat within an order: price and part tell rows apart
        (
            F.col("l_linenumber") * F.lit(10**17)
            + F.round(F.col("l_extendedprice") * 100).cast("long") * F.lit(10**9)
            + F.col("l_partkey")
        ).alias("row_no"),
        F.col("l_linenumber").cast("string").alias("c1"),
        F.col("l_partkey").cast("string").alias("c2"),
        F.col("l_returnflag").alias("c3"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")

    def block(seq: int, kind: str, row: Column, col: int, text: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"),
            F.lit(kind).alias("kind"),
            row.alias("row_no"),
            F.lit(col).alias("col_no"),
            text.alias("text"),
        )

    zero = F.lit(0).cast("long")
    cells = F.array(
        block(4, "table", F.col("row_no"), 1, F.col("c1")),
        block(4, "table", F.col("row_no"), 2, F.col("c2")),
        block(4, "table", F.col("row_no"), 3, F.col("c3")),
    )
    doc = F.col("o_orderkey").cast("string").alias("doc_id")
    dealt = lines.select(doc, *[c for c in lines.columns if c != "o_orderkey"]).repartition("doc_id", "page_no")
    table_cells = dealt.select("doc_id", "page_no", F.inline(cells))
    heads = F.array(
        block(1, "title", zero, 0, F.concat(F.lit("Order "), "doc_id")),
        block(2, "section_header", zero, 0, F.concat(F.lit("Status "), F.col("o_orderstatus"))),
        block(3, "figure", zero, 0, F.lit("logo")),
        block(4, "column_header", zero, 1, F.lit("line")),
        block(5, "text", zero, 0, F.concat(F.lit("Priority "), F.col("o_orderpriority"))),
    )
    per_page = lines.select("o_orderkey", "page_no").distinct()
    titles = per_page.join(orders, "o_orderkey").select(doc, "page_no", "o_orderstatus", "o_orderpriority")
    page_heads = titles.repartition("doc_id", "page_no").select("doc_id", "page_no", F.inline(heads))
    return table_cells.unionByName(page_heads)


def boxed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order forms without a sequence: a title over two columns of lines, odd and even numbers, and a
    note at the right margin. Lines of one number stand below each other."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.lit(1).alias("page_no"),
        "l_linenumber",
        F.concat_ws(" ", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("text"),
    )
    # lines with the same number and text are one block; one shuffle serves this and the numbering below
    lines = lines.repartition("doc_id").distinct()
    below = Window.partitionBy("doc_id", F.col("l_linenumber") % 2).orderBy("l_linenumber", "text")
    row = F.row_number().over(below)
    left = F.when(F.col("l_linenumber") % 2 == 1, 0).otherwise(300)
    columns = lines.select(
        "doc_id", "page_no", "text", left.alias("left"), (100 + row * 20).alias("top"),
        (left + 200).alias("right"), (110 + row * 20).alias("bottom"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), "o_orderstatus", "o_orderpriority")

    def block(text: Column, left: int, top: int, right: int, bottom: int) -> Column:
        values = {"left": left, "top": top, "right": right, "bottom": bottom}
        return F.struct(text.alias("text"), *[F.lit(v).alias(k) for k, v in values.items()])

    # the note begins beside the title, so no strip from side to side parts it from the lines
    heads = F.array(
        block(F.concat(F.lit("Order "), "doc_id"), 0, 0, 500, 40),
        block(F.concat(F.lit("Note "), "o_orderpriority"), 600, 10, 700, 900),
    )
    return orders.select("doc_id", F.lit(1).alias("page_no"), F.inline(heads)).unionByName(columns)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the answers of their parsers: system turns are empty, user turns hold nothing, and
    every fifth turn is broken off."""
    content = F.when(F.col("role") == "system", "").otherwise(F.coalesce("text", F.lit("")))
    nothing = F.col("role") == "user"

    def one(item: Column) -> Column:
        return F.when(nothing, F.slice(F.array(item), 1, 0)).otherwise(F.array(item))

    def named(value: Column, name: str) -> Column:
        return F.struct(value.alias(name))

    def chunk(text: Column) -> Column:
        return named(F.array(named(named(text, "content"), "delta")), "choices")

    chunks = F.array(chunk(F.left(content, F.lit(3))), chunk(F.lit(None).cast("string")), chunk(F.substring(content, 4, 2**31 - 1)))
    element = named(named(F.concat(F.lit("<p>"), content, F.lit("</p>")), "text_as_html"), "metadata")
    missing = F.lit(None)
    forms = {
        "openai": named(one(named(named(content, "content"), "message")), "choices"),
        "huggingface": F.when(nothing, F.slice(chunks, 1, 0)).otherwise(chunks),
        "anthropic": named(one(named(content, "text")), "content"),
        "googleai": named(F.when(nothing, missing).otherwise(content), "text"),
        "textract": named(F.when(nothing, missing).otherwise(content), "text"),
        "mistral": named(one(named(content, "markdown")), "pages"),
        "ollama": named(F.when(nothing, missing).otherwise(named(content, "content")), "message"),
        "unstructuredio": named(F.when(nothing, missing).otherwise(F.array(element)), "elements"),
    }
    parser = by_position(list(PARSER_NAMES), turn_parser(turn_position()))
    answer = F.lit(None).cast("string")
    for name, form in forms.items():
        told = F.to_json(form, {"ignoreNullFields": "false"})
        answer = F.when(F.col("parser") == name, told).otherwise(answer)
    broken = F.pmod(turn_position(), F.lit(5)) == 4
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("parser", parser)
        .withColumn("answer", answer)
        .select(
            turn_document().alias("doc_id"),
            (turn_position() + 1).alias("page_no"),
            "parser",
            F.when(broken, F.left("answer", F.length("answer") - 1)).otherwise(F.col("answer")).alias("answer"),
        )
    )


def requested_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per document; the language decides the suffix."""
    suffix = (
        F.when(F.col("lang") == "en", ".pdf")
        .when(F.col("lang") == "de", ".PDF")
        .when(F.col("lang") == "fr", ".txt")
        .otherwise(".pdf")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("in/"), F.col("source"), F.lit("/doc."), F.col("doc_id"), suffix).alias(
            "path"
        ),
    )


def input_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing shows: labelled documents exist, toxic ones are folders."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        requested_inputs(spark, sf_dir)
        .join(labels, "doc_id")
        .select("path", (F.col("toxic") == 0).alias("is_file"))
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per document: the source picks a parser (two pick one that is not
    registered), the language a model (none, empty, the newest, a foreign one)."""
    names = [*PARSER_NAMES, "markitdown", "pandoc"]
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    model = (
        F.when(F.col("lang") == "en", F.lit(None).cast("string"))
        .when(F.col("lang") == "de", "")
        .when(F.col("lang") == "fr", "gpt-4o")
        .otherwise("gemini-1.5-flash")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        by_position(names, F.pmod(number, F.lit(len(names)))).alias("parser"),
        model.alias("model"),
    )
