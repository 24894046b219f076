"""Reading order of layout blocks that have boxes and no sequence, by recursive X-Y cuts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")


def _not_less(a: np.ndarray, b) -> np.ndarray:
    return (a >= b) | np.isnan(a)  # nothing is more than NaN, as in Spark


def _gaps(groups: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and start, and the free space before each block on an axis, -inf for the first of its group."""
    order = np.lexsort((ids, end, start, groups))
    g = groups[order]
    values, rank = np.unique(end[order], return_inverse=True)
    # the rank of the furthest end so far: groups are in order, so a later one begins above all before it
    reach = np.maximum.accumulate(g * np.int64(len(values)) + rank)
    gap = np.full(len(g), -np.inf)
    with np.errstate(invalid="ignore"):
        gap[1:] = start[order][1:] - values[reach[:-1] % len(values)]
    gap[np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))] = -np.inf
    return order, gap


def _parts(groups: np.ndarray, order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Number of cuts before each block within its group, in the blocks' own order."""
    g, before = groups[order], np.cumsum(cut)
    firsts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    out = np.empty(len(g), np.int64)
    out[order] = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(g))))
    return out


def places(sizes: np.ndarray, boxes: list[np.ndarray], ids: np.ndarray, boxed: np.ndarray, column_gap: float) -> np.ndarray:
    """Place on its page, from 1, of each block of pages that lie behind each other.

    ``sizes`` are the pages' numbers of blocks; ``boxes`` are left, top, right and bottom, NaN where not
    ``boxed``. A round cuts all groups of all pages once: at all column gaps, or else at the widest gaps between lines.
    """
    left, top, right, bottom = boxes
    pages = np.repeat(np.arange(len(sizes)), sizes)
    label = pages * 2 + ~boxed.all(axis=0)  # what has no box stands behind
    rows = np.flatnonzero(label % 2 == 0)
    while len(rows):
        _, groups = np.unique(label[rows], return_inverse=True)
        firsts = np.concatenate([[0], np.cumsum(np.bincount(groups))[:-1]])
        by_x, gap_x = _gaps(groups, left[rows], right[rows], ids[rows])
        by_y, gap_y = _gaps(groups, top[rows], bottom[rows], ids[rows])
        widest_x, widest_y = np.maximum.reduceat(gap_x, firsts), np.maximum.reduceat(gap_y, firsts)
        columns = _not_less(widest_x, column_gap)
        lines = ~columns & _not_less(widest_y, 0)
        part_x = _parts(groups, by_x, _not_less(gap_x, column_gap))
        part_y = _parts(groups, by_y, _not_less(gap_y, widest_y[groups[by_y]]))
        part = np.where(columns[groups], part_x, np.where(lines[groups], part_y, 0))
        full = np.zeros(len(label), np.int64)
        full[rows] = part
        label = np.unique(label * (part.max() + 1) + full, return_inverse=True)[1].astype(np.int64)
        rows = rows[(columns | lines)[groups]]
    keys = [ids]
    for values, known in zip((right, bottom, left, top), (boxed[2], boxed[3], boxed[0], boxed[1])):
        keys += [values, known]  # nulls first
    order = np.lexsort((*keys, label, pages))
    out = np.empty(len(order), np.int32)
    starts = np.cumsum(sizes) - sizes
    out[order] = np.arange(len(order)) - np.repeat(starts, sizes) + 1
    return out


def _places_of(column_gap: float):
    def run(left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array, ids: pa.Array) -> pa.Array:
        flat = [c.flatten() for c in (left, top, right, bottom)]
        boxed = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in flat])
        boxes = [c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in flat]
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        out = places(sizes, boxes, ids.flatten().to_numpy(zero_copy_only=False), boxed, column_gap)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))

    return F.arrow_udf(run, "array<int>")


def reading_order(blocks: DataFrame, column_gap: float = 10.0) -> DataFrame:
    """``blocks`` with ``seq``, the place of each block on its page, from 1.

    ``blocks`` have ``doc_id, page_no, left, top, right, bottom``; other columns pass. The blocks of a page are
    cut into columns, read from left to right, where a free strip of at least ``column_gap`` goes from top to bottom
    between them, and else into lines, read from top to bottom, at the widest free strips from side to side; each
    part is cut in the same way until none can be. What overlaps stays together and is read by
    top, left, and the row's other values.

    The blocks are shuffled once, by page, and a page is one row until its places are known; only boxes go through
    Python, many pages at a time. A block without a box stands at the end of its page.
    """
    given = [c for c in blocks.columns if c != "seq"]
    rest = [F.col(f"`{c}`").cast("string") for c in given if c not in PAGE]
    order = F.xxhash64(*[F.coalesce(c, F.lit("\u0000")) for c in rest])
    own = [c for c in given if c not in PAGE]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], order.alias("_id"))
    pages = blocks.repartition(*PAGE).groupBy(*PAGE).agg(F.collect_list(row).alias("_rows"))

    def values(name: str, kind: str) -> Column:
        return F.transform("_rows", lambda x: x[name].cast(kind))

    boxes = [values(f"c{own.index(c)}", "double") for c in ("left", "top", "right", "bottom")]
    placed = pages.withColumn("_seq", _places_of(column_gap)(*boxes, values("_id", "long")))
    rows = placed.select(*PAGE, F.posexplode("_rows").alias("_i", "_row"), "_seq")
    out = {c: F.col(f"_row.c{i}") for i, c in enumerate(own)} | {c: F.col(c) for c in PAGE}
    return rows.select(*[out[c].alias(c) for c in given], F.get("_seq", F.col("_i")).alias("seq"))


def ordered_text(blocks: DataFrame, keep: Sequence[str] = PAGE) -> DataFrame:
    """Page texts of blocks in reading order, a blank line between blocks."""
    lines = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return blocks.groupBy(*keep).agg(
        F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("page_text")
    )
