"""Structured conversion output (elements, HTML, layout blocks) to text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscore.functions.columns import substitute

# The page that wraps element HTML.
HTML_HEAD = (
    "<!DOCTYPE html><html>\n"
    "<head><style>table, th, td { border: 1px solid; }</style></head>\n"
    "<body>\n"
)
HTML_TAIL = "</body></html>"

_TAG_END = r"(?:\s[^>]*)?>"
_BLOCKS = "p|div|ul|ol|table|article|section|nav|header|footer|body|html"

# The ordered HTML rules (pattern, replacement), in groups under
# the marks without which they cannot match.
HTML_GROUPS: tuple[tuple[tuple[str, ...], tuple[tuple[str, str], ...]], ...] = (
    # what is never shown
    (("<!--",), ((r"(?s)<!--.*?-->", ""),)),
    (("<head",), ((rf"(?s)<head{_TAG_END}.*?</head>", ""),)),
    (("<script",), ((rf"(?s)<script{_TAG_END}.*?</script>", ""),)),
    (("<style",), ((rf"(?s)<style{_TAG_END}.*?</style>", ""),)),
    # headings
    *(
        (
            (f"<h{n}",),
            ((rf"(?s)<h{n}{_TAG_END}\s*(.*?)\s*</h{n}>", "\n\n" + "#" * n + " $1\n\n"),),
        )
        for n in range(1, 7)
    ),
    # emphasis, links, line breaks, list items
    (
        ("<",),
        (
            (rf"</?(?:b|strong){_TAG_END}", "**"),
            (rf"</?(?:i|em){_TAG_END}", "*"),
            (r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
            (r"<br\s*/?>", "\n"),
            (rf"<li{_TAG_END}", "\n* "),
        ),
    ),
    # tables
    (
        ("<tr", "</td", "</th"),
        (
            (rf"</t[dh]>\s*<t[dh]{_TAG_END}", " | "),
            (rf"<tr{_TAG_END}\s*<t[dh]{_TAG_END}", "\n| "),
            (r"</t[dh]>\s*</tr>", " |"),
        ),
    ),
    # blocks, then every other tag
    (("<",), ((rf"</?(?:{_BLOCKS}){_TAG_END}", "\n\n"), (r"<[^>]+>", ""))),
    # entities, the ampersand last
    (
        ("&",),
        (
            ("&nbsp;", " "),
            ("&lt;", "<"),
            ("&gt;", ">"),
            ("&quot;", '"'),
            ("&#39;", "'"),
            ("&copy;", "©"),
            ("&middot;", "·"),
            ("&amp;", "&"),
        ),
    ),
    # white space
    (
        (),
        (
            (r"[ \t]+\n", "\n"),
            (r"\n{3,}", "\n\n"),
            (r"^\n+", ""),
            (r"\n+\z", ""),
        ),
    ),
)


def elements_to_html(elements: DataFrame) -> DataFrame:
    """One HTML page per document from the elements that carry HTML.

    Plain-text elements are dropped; a document without HTML keeps the wrapper.
    """
    html = F.when(
        F.map_contains_key("metadata", "text_as_html"),
        F.struct("seq", F.col("metadata")["text_as_html"].alias("_h")),
    )
    # collect_list leaves nulls out, so dropped elements are not shuffled
    ordered = F.transform(
        F.sort_array(F.collect_list(html)), lambda x: F.concat(x["_h"], F.lit("\n"))
    )
    return elements.groupBy("doc_id").agg(
        F.concat(F.lit(HTML_HEAD), F.array_join(ordered, ""), F.lit(HTML_TAIL)).alias("html")
    )


def html_to_markdown(html: Column | str) -> Column:
    """Markdown of an HTML column by the ordered rules."""
    return substitute(F.col(html) if isinstance(html, str) else html, HTML_GROUPS)


def _page_parts(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks again in tables of whole pages; step 4 opens a page."""
    held: list[pa.RecordBatch] = []
    for batch in blocks:
        opens = np.flatnonzero(batch.column("_step").to_numpy(zero_copy_only=False) == 4)
        if len(opens) and (held or opens[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, opens[-1])])
            held = []
        held.append(batch.slice(opens[-1]) if len(opens) else batch)
    if held:
        yield pa.Table.from_batches(held)


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _joined(texts: pa.Array, counts: np.ndarray, mark: str) -> pa.Array:
    """Runs of ``counts`` texts that lie behind each other, each run as one text."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts), _large(mark))


def _page_texts(blocks: pa.Table, header_threshold: float) -> pa.RecordBatch:
    """Texts of whole pages from their ordered blocks, all pages at once."""
    step, table, header, other = (
        blocks.column(c).to_numpy() for c in ("_step", "_table", "_header", "_other_seq")
    )
    text = blocks.column("text").cast(pa.large_string()).combine_chunks()
    starts = np.flatnonzero(step > 0)  # of lines
    sizes = np.diff(np.append(starts, len(step)))
    known = text.is_valid()
    cells = np.add.reduceat(known.to_numpy(zero_copy_only=False).astype(np.int64), starts)
    lines = _joined(text.filter(known), cells, " | ")
    rows = table[starts]
    lines = pc.if_else(pa.array(rows), pc.binary_join_element_wise(_large("| "), lines, _large(" |"), _large("")), lines)
    share = np.add.reduceat(header.astype(np.int64), starts) / sizes
    kept = ~rows | (share < header_threshold)
    # a table row and another line of the same place are ordered by their texts
    second = np.flatnonzero(step[starts] == 1)
    if len(second):
        turned = pc.greater(lines.take(pa.array(second - 1)), lines.take(pa.array(second)))
        second = second[turned.to_numpy(zero_copy_only=False)]
        order = np.arange(len(starts))
        order[second], order[second - 1] = second - 1, second
        lines, kept = lines.take(pa.array(order)), kept[order]
    page = np.cumsum(step[starts] == 4)[kept]
    seq = np.cumsum(other)[starts][kept]
    first = np.diff(page, prepend=0) > 0
    same = ~first & (np.diff(seq, prepend=0) == 0)
    leads = pa.array(["", "\n", "\n\n"], pa.large_string()).take(pa.array(np.where(first, 0, np.where(same, 1, 2))))
    parts = pc.binary_join_element_wise(leads, lines.filter(pa.array(kept)), _large(""))
    pages, counts = np.unique(page, return_counts=True)
    keys = blocks.select(["doc_id", "page_no"]).take(pa.array(np.flatnonzero(step == 4)[pages - 1]))
    made = _joined(parts, counts, "")
    return pa.RecordBatch.from_arrays(
        [*(c.combine_chunks() for c in keys.columns), made], ["doc_id", "page_no", "page_text"]
    )


def linearize_layout(blocks: DataFrame, header_threshold: float = 0.7) -> DataFrame:
    """Text of each page in reading order from its layout blocks.

    ``title`` and ``section_header`` get their prefixes, ``figure`` is hidden,
    ``table`` cells become ``| a | b |`` rows, other kinds stay as they are, and
    blocks are parted by blank lines. A table row is a header, and left out, when
    at least ``header_threshold`` of its cells are ``column_header`` cells. The
    text of a merged cell stands in its first place only: cells of kind
    ``merged`` are empty.

    The blocks are sorted once, within their pages; blocks that are dealt out by
    page or document are not shuffled again. Joining the sorted texts goes through
    Python, many pages at a time.
    """
    kind = F.col("kind")
    text = (
        F.when(kind == "title", F.concat(F.lit("# "), "text"))
        .when(kind == "section_header", F.concat(F.lit("## "), "text"))
        .when(kind == "merged", F.lit(""))
        .otherwise(F.col("text"))
    )
    order = ["seq", "row_no", "_table", "col_no", "text"]
    page = Window.partitionBy("doc_id", "page_no").orderBy(*order)
    seq, row, table = (F.lag(c).over(page).eqNullSafe(F.col(c)) for c in order[:3])
    # what a block opens: 4 a page, 2 a row, 1 a line of other kind in its place, 0 nothing
    step = F.when(F.row_number().over(page) == 1, 4).when(~(seq & row), 2).when(~table, 1).otherwise(0)
    # a missing seq is like no other
    other = ~seq | F.col("seq").isNull()
    ordered = (
        blocks.where(kind != "figure")
        .select(
            "doc_id",
            "page_no",
            "seq",
            "row_no",
            "col_no",
            kind.isin("table", "column_header", "merged").alias("_table"),
            (kind == "column_header").alias("_header"),
            text.alias("text"),
        )
        .withColumns({"_step": step, "_other_seq": other})
        .sortWithinPartitions("doc_id", "page_no", *order)  # as the window leaves them: no sort of its own
        .select("doc_id", "page_no", "text", "_table", "_header", "_step", "_other_seq")
    )
    keys = [blocks.schema["doc_id"], blocks.schema["page_no"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _page_parts(batches):
            yield _page_texts(part, header_threshold)

    return ordered.mapInArrow(run, StructType([*keys, StructField("page_text", StringType())]))
