"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, letters and characters outside ASCII, with A-Z lower-cased. The patterns
are all windows of 13 consecutive words of the benchmark items; an item of fewer words is one
pattern. Patterns of one length share a table:

* the shift table has, for every block of ``BLOCK`` words in a pattern, how far the search may go on
  when it reads that block; any other block allows the largest step, so most words of a document
  are never looked up;
* a block that ends a pattern has a bucket, keyed by the pattern's last and first block;
* the patterns of a bucket are compared word by word with the text.

The benchmark is the query set and small against the documents. It is cut in slices of at most
``SLICE_BYTES`` of text; the driver and the tasks hold the tables of slices, and the documents pass
the slices one after the other in one stage without a shuffle. A single item must fit a slice.

Defined results: a null text has no words and no hits. Items without words never occur; null item
ids are left out. Repeated documents are judged each for itself; items with equal texts are all
listed, an id once. Extra columns pass unchanged; ``n_words``, ``n_hit``, ``items`` and
``contaminated`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscore.llm.arrow import row_udf

WINDOW = 13
BLOCK = 3
SLICE_BYTES = 8 << 20
SCAN_TYPE = "struct<n_words:long,starts:array<int>,ends:array<int>,items:array<long>>"

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class PatternTable:
    """Shift table and buckets of patterns that all have ``length`` words."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.step = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple]] = {}
        self.owners: dict[tuple, set[int]] = {}

    def add(self, pattern: tuple, item: int) -> None:
        owners = self.owners.setdefault(pattern, set())
        if not owners:
            size = self.block
            for end in range(size, self.length + 1):
                block = pattern[end - size : end]
                self.shift[block] = min(self.shift.get(block, self.step), self.length - end)
            ends = (pattern[-size:], pattern[:size])
            self.buckets.setdefault(ends, []).append(pattern)
        owners.add(item)

    def search(self, words: list[bytes]) -> Iterable[tuple[int, set[int]]]:
        """Start and items of every occurrence."""
        length, size, shift, step = self.length, self.block, self.shift, self.step
        at, n = length, len(words)
        while at <= n:
            block = tuple(words[at - size : at])
            jump = shift.get(block, step)
            if jump:
                at += jump
                continue
            start = at - length
            bucket = self.buckets.get((block, tuple(words[start : start + size])))
            if bucket:
                text = tuple(words[start:at])
                for pattern in bucket:
                    if pattern == text:
                        yield start, self.owners[pattern]
            at += 1


def build_tables(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[PatternTable]:
    tables: dict[int, PatternTable] = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        length = min(window, len(words))
        table = tables.setdefault(length, PatternTable(length))
        for i in range(len(words) - length + 1):
            table.add(tuple(words[i : i + length]), item)
    return list(tables.values())


def scan(text: str | None, tables: list[PatternTable]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, runs of hit words, items found."""
    words = words_of(text)
    spans, found = [], set()
    for table in tables:
        for start, owners in table.search(words):
            spans.append((start, start + table.length))
            found |= owners
    return len(words), merge_runs(spans), found


def merge_runs(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


def _slices(benchmark: DataFrame, slice_bytes: int) -> list[list[tuple[int, str]]]:
    """Slices of the benchmark, each read by itself."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter(
        "item_id is not null and text is not null"
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * total // slice_bytes
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[tuple(r) for r in rows.filter(part == k).toLocalIterator()] for k in range(n)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Add ``n_words, n_hit, items`` and ``contaminated`` to ``docs``.

    ``n_hit`` is the number of words inside occurrences of windows, ``items`` the ids of the items
    whose windows occur; a document is contaminated if at least a twentieth of its words is hit.
    """
    spark = docs.sparkSession
    out = docs.withColumn("_found", F.lit(None).cast(SCAN_TYPE))
    for items in _slices(benchmark, slice_bytes):
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared):
            tables = build_tables(shared.value, window)

            def search(text, before):
                n, runs, found = scan(text, tables)
                if before is not None:
                    runs = merge_runs([*runs, *zip(before["starts"], before["ends"])])
                    found = found | set(before["items"])
                return n, [r[0] for r in runs], [r[1] for r in runs], sorted(found)

            return search

        out = out.withColumn("_found", row_udf(SCAN_TYPE, make)("text", "_found"))
    hit = F.aggregate(
        F.zip_with("_found.starts", "_found.ends", lambda s, e: e - s),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return (
        out.withColumns({"n_words": F.col("_found.n_words"), "n_hit": hit, "items": F.col("_found.items")})
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
        .drop("_found")
    )
