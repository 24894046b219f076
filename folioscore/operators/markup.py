"""HTML to Markdown with a stack of open tags, in native functions.

The page is cut into tags and texts, and the array is folded once. The state of the fold is the pieces
written so far, the inline tags that are open with the place of their first mark, and the open lists with
their counters. An inline tag writes its marks when it is closed, at both places at once, so one that is never
closed, or is cut off by the end of its block, leaves none. Nested lists are indented by four
spaces a level, and the items of an ordered list are numbered, each list by its own.

Written for pages: the fold copies the pieces' addresses with every tag, so its cost grows with the
square of a page's tags, and stays small beside the text for pages of some thousand tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscore.functions.columns import let, substitute

# What is never shown, entities (the ampersand last), marks and kinds of tags.
HIDDEN = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(head|script|style)(?:\s[^>]*)?>.*?</\1\s*>", ""),
)
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
BLOCKS = ("p", "div", "table", "article", "section", "nav", "header", "footer", "body", "html", "blockquote")
STATE = (
    "struct<out:array<string>,open:array<struct<kind:string,at:int,href:string>>,"
    "lists:array<struct<ordered:boolean,n:int>>>"
)
_INDENT = "    "


def _state(out: Column, open_: Column, lists: Column) -> Column:
    return F.struct(out.alias("out"), open_.alias("open"), lists.alias("lists")).cast(STATE)


def _write(s: Column, piece: Column | str) -> Column:
    return F.concat(s["out"], F.array(F.lit(piece) if isinstance(piece, str) else piece))


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def _none_open(s: Column) -> Column:
    return F.slice(s["open"], 1, 0)


def _fold(s: Column, token: Column) -> Column:
    """The state after a token: a struct of ``text``, ``name`` (empty for a text), ``closing`` and ``href``."""
    name, closing = token["name"], token["closing"]
    kind = F.lit("")
    for tag, mark in MARKS.items():
        kind = F.when(name == tag, mark).otherwise(kind)
    kind = F.when(name == "a", "a").otherwise(kind)

    def block(piece: Column | str, lists: Column | None = None) -> Column:
        """A piece at which open inline tags end without a mark."""
        return _state(_write(s, piece), _none_open(s), s["lists"] if lists is None else lists)

    opened = F.struct(kind.alias("kind"), F.size(s["out"]).alias("at"), token["href"].alias("href"))
    open_inline = _state(_write(s, ""), F.concat(s["open"], F.array(opened)), s["lists"])

    # the innermost open tag of the kind; what was opened inside of it and not closed is given up
    place = F.array_max(F.filter(F.transform(s["open"], lambda o, i: F.when(o["kind"] == kind, i)), lambda i: i.isNotNull()))
    entry = F.get(s["open"], place)
    content = F.array_join(F.slice(s["out"], entry["at"] + 1, F.size(s["out"])), "")
    shown = F.rlike(content, F.lit(r"\S")) & ((kind != "a") | entry["href"].isNotNull())
    first = F.when(kind == "a", "[").otherwise(kind)
    last = F.when(kind == "a", F.concat(F.lit("]("), entry["href"], F.lit(")"))).otherwise(kind)
    marked = F.transform(s["out"], lambda p, i: F.when(i == entry["at"], first).otherwise(p))
    close_inline = F.when(place.isNull(), s).otherwise(
        _state(
            F.when(shown, F.concat(marked, F.array(last))).otherwise(s["out"]),
            F.slice(s["open"], F.lit(1), place),
            s["lists"],
        )
    )

    depth = F.size(s["lists"])
    new_list = F.concat(s["lists"], F.array(F.struct((name == "ol").alias("ordered"), F.lit(0).alias("n"))))
    open_list = block(F.when(depth == 0, "\n\n").otherwise(""), new_list)
    close_list = block(F.when(depth <= 1, "\n\n").otherwise(""), _but_last(s["lists"]))
    top = F.coalesce(F.get(s["lists"], depth - 1), F.struct(F.lit(False).alias("ordered"), F.lit(0).alias("n")))
    counted = F.array(F.struct(top["ordered"].alias("ordered"), (top["n"] + 1).alias("n")))
    mark = F.when(top["ordered"], F.concat((top["n"] + 1).cast("string"), F.lit(". "))).otherwise("* ")
    item = F.concat(F.lit("\n"), F.repeat(F.lit(_INDENT), F.greatest(depth - 1, F.lit(0))), mark)
    open_item = block(item, F.when(depth > 0, F.concat(_but_last(s["lists"]), counted)).otherwise(s["lists"]))

    heading = F.rlike(name, F.lit("^h[1-6]$"))
    hashes = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(name, 2, 1).cast("int")), F.lit(" "))
    text = F.regexp_replace(token["text"], r"(?U)[\s&&[^ ]]+", " ")
    return (
        F.when(name == "", _state(_write(s, text), s["open"], s["lists"]))
        .when((kind != "") & ~closing, open_inline)
        .when(kind != "", close_inline)
        .when(name == "br", _state(_write(s, "\n"), s["open"], s["lists"]))
        .when(heading, block(F.when(closing, "\n\n").otherwise(hashes)))
        .when(name.isin("ul", "ol"), F.when(closing, close_list).otherwise(open_list))
        .when(name == "li", F.when(closing, block("")).otherwise(open_item))
        .when(name == "tr", block(F.when(closing, "").otherwise("\n|")))
        .when(name.isin("td", "th"), block(F.when(closing, " |").otherwise(" ")))
        .when(name.isin(*BLOCKS), block("\n\n"))
        .otherwise(s)
    )


def html_to_markdown_nested(html: Column | str) -> Column:
    """Markdown of an HTML column; null for null.

    Headings, emphasis, links, line breaks, nested and ordered lists, tables, blocks and the entities of
    ``ENTITIES``; other tags are left out and their text stays. ``<`` that begins no tag is text.
    """
    column = F.col(html) if isinstance(html, str) else html
    cleaned = substitute(column, [((), HIDDEN)])
    parts = F.regexp_extract_all(cleaned, F.lit(r"(?s)(</?[a-zA-Z][^>]*>|<(?!/?[a-zA-Z][^>]*>)|[^<]+)"), F.lit(1))

    def token(p: Column) -> Column:
        tag = F.rlike(p, F.lit(r"^</?[a-zA-Z][^>]*>$"))
        href = F.regexp_extract(p, r"""(?is)\shref\s*=\s*["']([^"']*)["']""", 1)
        return F.struct(
            p.alias("text"),
            F.when(tag, F.lower(F.regexp_extract(p, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))).otherwise("").alias("name"),
            (tag & F.startswith(p, F.lit("</"))).alias("closing"),
            F.nullif(href, F.lit("")).alias("href"),
        )

    start = _state(
        F.array().cast("array<string>"),
        F.array().cast("array<struct<kind:string,at:int,href:string>>"),
        F.array().cast("array<struct<ordered:boolean,n:int>>"),
    )
    pieces = let(F.transform(parts, token), lambda tokens: F.aggregate(tokens, start, _fold, lambda s: s["out"]))
    joined = F.array_join(pieces, "")
    tidy = ((r"(\S) {2,}", "$1 "), (r"[ \t]+\n", "\n"), (r"\n (?! )", "\n"), (r"\n{3,}", "\n\n"), (r"^[\n ]+", ""), (r"[\n ]+\z", ""))
    return substitute(joined, [((), tidy), (("&",), ENTITIES)])
