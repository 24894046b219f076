"""Pairs of the variants of one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR_KEY = ("filestem", "file1", "ord1", "file2", "ord2")
#: Variants of a block, so pairs of a tile are at most its square.
TILE = 256
#: Documents of several blocks whose numbers are broadcast; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 100_000


def variant_pairs(
    variants: DataFrame, carry: Sequence[str] = (), others: DataFrame | None = None
) -> DataFrame:
    """Combinations with replacement of each document's variants.

    Each unordered pair and each variant with itself appear once, the smaller
    ``(ord, file)`` first: n(n+1)/2 rows for n variants. ``carry`` names columns
    brought along with suffixes 1 and 2.

    It is a self-join on the document key. Both inputs are the same plan up to
    names, so Spark shuffles the variants once and reads that shuffle twice (a
    broadcast would make the features of every text a second time). The
    key sits directly on the shuffle, which lets AQE split a document that has
    many more variants than others over several tasks.

    With ``others``, only pairs between the two tables are formed, oriented the
    same way (used where new variants meet stored ones): one join, after which a
    pair that stands the wrong way round is turned.
    """

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(
            F.col("filestem").alias(f"_stem{n}"),
            F.col("file").alias(f"file{n}"),
            F.col("ord").alias(f"ord{n}"),
            *[F.col(c).alias(f"{c}{n}") for c in carry],
        )

    same_document = F.col("_stem1") == F.col("_stem2")
    right = variants if others is None else others
    if others is None:
        same_document &= F.struct("ord1", "file1") <= F.struct("ord2", "file2")
    pairs = side(variants, 1).join(side(right, 2).hint("merge"), same_document)
    stem = F.col("_stem1").alias("filestem")
    if others is None:
        return pairs.select(stem, *PAIR_KEY[1:], *[f"{c}{n}" for c in carry for n in (1, 2)])
    return pairs.select(stem, *turned(carry))


def turned(carry: Sequence[str]) -> list[Column]:
    """Columns of a pair, exchanged where the first variant comes after the second."""
    after = F.struct("ord2", "file2") < F.struct("ord1", "file1")

    def ordered(name: str, n: int) -> Column:
        mine, other = F.col(f"{name}{n}"), F.col(f"{name}{3 - n}")
        return F.when(after, other).otherwise(mine).alias(f"{name}{n}")

    key = [ordered(c, n) for n in (1, 2) for c in ("file", "ord")]
    return key + [ordered(c, n) for c in carry for n in (1, 2)]


def tiled_pairs(
    variants: DataFrame, carry: Sequence[str] = (), tile: int = TILE, tasks: int | None = None
) -> DataFrame:
    """The pairs of ``variant_pairs``, with the work of a large document parted by plan.

    The variants of a document with more than ``tile`` are dealt to blocks of about that many by a hash of
    their name, and every pair of blocks is a tile of its own: a variant is sent to as many tiles as
    there are blocks, once to each, and a join by tile forms the pairs. So the pairs that meet in a
    task are bounded by the tiles it has, and not by the largest document. Documents of one
    block have one tile and are sent once on either side.

    The documents that need parting are counted first, over names alone; where there are none, this
    is ``variant_pairs``. ``tasks`` is the number of partitions of the join.
    """
    counted = variants.groupBy("filestem").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    large = counted.select(F.col("filestem").alias("_large"), F.ceil(F.col("_n") / tile).cast("int").alias("_blocks"))
    documents = large.count()
    if not documents:
        return variant_pairs(variants, carry)
    if documents <= BROADCAST_DOCUMENTS:
        large = F.broadcast(large)
    blocks = F.coalesce("_blocks", F.lit(1))
    placed = variants.join(large, F.col("filestem") == F.col("_large"), "left").select(
        "filestem",
        "file",
        "ord",
        *carry,
        blocks.alias("_blocks"),
        F.pmod(F.xxhash64("file", "ord"), blocks).cast("int").alias("_block"),
    )

    def side(n: int, others: Column) -> DataFrame:
        sent = placed.select("filestem", "file", "ord", *carry, "_block", F.explode(others).alias("_other"))
        i, j = ("_block", "_other") if n == 1 else ("_other", "_block")
        rows = sent.select(
            F.col("filestem").alias(f"_stem{n}"),
            F.col(i).alias(f"_i{n}"),
            F.col(j).alias(f"_j{n}"),
            F.col("file").alias(f"file{n}"),
            F.col("ord").alias(f"ord{n}"),
            *[F.col(c).alias(f"{c}{n}") for c in carry],
        )
        keys = (f"_stem{n}", f"_i{n}", f"_j{n}")
        return rows.repartition(tasks, *keys) if tasks else rows

    left = side(1, F.sequence(F.col("_block"), F.col("_blocks") - 1))
    right = side(2, F.sequence(F.lit(0), F.col("_block")))
    same_tile = (F.col("_stem1") == F.col("_stem2")) & (F.col("_i1") == F.col("_i2")) & (F.col("_j1") == F.col("_j2"))
    # within a block each unordered pair is met twice, between two blocks once
    once = (F.col("_i1") < F.col("_j1")) | (F.struct("ord1", "file1") <= F.struct("ord2", "file2"))
    pairs = left.join(right.hint("merge"), same_tile & once)
    return pairs.select(F.col("_stem1").alias("filestem"), *turned(carry))
