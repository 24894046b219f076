"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has the signs of its ``BITS`` components. Codes are cut in segments of about
``log2(number of codes)`` bits, and every segment of a code is an index entry. The index is dealt to
shares by a hash of the codes and the queries to batches; a task holds one share and one batch and makes
the probes there. So a round shuffles a row per query and share and a row per code and batch, however
many probes there are. A query probes
segments at radius 0, then 1, and so on: after radius ``r`` in the first ``j`` of ``m`` segments, and
``r - 1`` in the others, every code not met differs in at least ``m r + j`` bits. A query stops as soon
as that is more than the distance of its k-th verified row, so its result is exact.

A pair of codes is verified once: where its first matching probe is. Equal codes are one index
entry with its ``k + 1`` least ids, which are all that a top-k can use; queries with equal
codes are answered once. Each round is written to the shared folder; the driver only asks
whether queries are left.

Defined results: row per query and rank ``query_id, rank, id, distance``, ordered by distance and
id; a query does not find its own id. Null vectors and null ids are not indexed and are no queries;
null and missing components count as not positive; a vector of more than ``BITS`` components stops the
job. Repeated rows of one id are one row of the
index per code. With fewer than ``k`` others a query has fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscore.session import workspace

BITS = 64
#: Most codes, and most queries, that a task holds, about.
SHARE = 1 << 17
_CELLS = 1 << 20


def sign_code(vector: str) -> Column:
    """Bit i is set where component i is positive; a vector of more than ``BITS`` components stops the job."""
    code = F.expr(
        f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    )
    too_long = F.raise_error(F.lit(f"a vector has more than {BITS} components")).cast("bigint")
    return F.when(F.size(F.col(vector)) > BITS, too_long).otherwise(code)


def segments(count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """First bit and length of each segment, for an index of ``count`` codes."""
    m = min(bits, max(1, round(bits / max(1.0, math.log2(max(count, 2))))))
    cuts = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(codes: np.ndarray, first: int, length: int) -> np.ndarray:
    return (codes >> np.uint64(first)) & np.uint64((1 << length) - 1)


def _new(apart: np.ndarray, parts: list[tuple[int, int]], part: int, radius: int) -> np.ndarray:
    """Whether no earlier probe meets the pairs that segment ``part`` has met, from their differing bits."""
    new = np.ones(len(apart), bool)
    for j, (first, length) in enumerate(parts):
        bits = np.bitwise_count(_segment(apart, first, length))
        new &= (bits > radius) if j < part else (bits >= radius)
    return new


def _matches(keys: np.ndarray, asked: np.ndarray, length: int, radius: int):
    """Runs of ``(query, code)`` places whose keys differ in ``radius`` of ``length`` bits, of about ``_CELLS`` each."""
    if math.comb(length, radius) > len(keys):  # fewer keys than probes: all are compared
        step = max(1, _CELLS // len(keys))
        for k in range(0, len(asked), step):
            query, code = np.nonzero(np.bitwise_count(asked[k : k + step, None] ^ keys) == radius)
            yield query + k, code
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    flips = np.array([sum(1 << bit for bit in bits) for bits in combinations(range(length), radius)], np.uint64)
    step = max(1, _CELLS // len(flips))
    for k in range(0, len(asked), step):
        probes = (asked[k : k + step, None] ^ flips).ravel()
        start = np.searchsorted(ordered, probes, "left")
        met = np.searchsorted(ordered, probes, "right") - start
        hits = np.flatnonzero(met)
        start, met = start[hits], met[hits]
        run = np.cumsum(met) // _CELLS
        for cut in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(run)) + 1):
            n = met[cut]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[cut], n)
            yield np.repeat(hits[cut] // len(flips) + k, n), order[place]


def _probe(parts: list[tuple[int, int]], radius: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of a share of the codes and the queries: ``query, code, distance`` of the pairs met at ``radius``."""

    def found(index: pa.Table, active: pa.Table) -> pa.Table:
        codes, queries = (t[c].to_numpy().view(np.uint64) for t, c in ((index, "code"), (active, "query")))
        bounds = active["bound"].to_numpy()
        out = [(queries[:0], codes[:0], np.zeros(0, np.int32))]
        for part, (first, length) in enumerate(parts):
            # the segment is needed while m * radius + part is not above the bound
            need = np.flatnonzero(bounds >= len(parts) * radius + part)
            if radius > length or not len(need) or not len(codes):
                continue
            asked = _segment(queries[need], first, length)
            for at, code in _matches(_segment(codes, first, length), asked, length, radius):
                query = need[at]
                apart = queries[query] ^ codes[code]
                distance = np.bitwise_count(apart).astype(np.int32)
                keep = (distance <= bounds[query]) & _new(apart, parts, part, radius)
                out.append((queries[query[keep]], codes[code[keep]], distance[keep]))
        query, code, distance = (np.concatenate(c) for c in zip(*out))
        columns = [pa.array(query.view(np.int64)), pa.array(code.view(np.int64)), pa.array(distance)]
        return pa.table(columns, names=["query", "code", "distance"])

    return found


def hamming_topk(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, distance``; ``items`` and ``queries`` have ``id, code``."""
    spark = items.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = workspace(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    known = items.filter("id is not null and code is not null").select("id", "code").distinct()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    index = kept(
        known.withColumn("_place", first)
        .filter(F.col("_place") <= k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "codes",
    )
    count = index.count()
    parts = segments(count)
    m = len(parts)
    asked = queries.filter("id is not null and code is not null").select("id", "code").distinct()
    active = kept(
        asked.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS)), "active"
    )
    # few shares, as every one is probed with all patterns; queries are dealt to all tasks
    shares = max(1, math.ceil(count / SHARE))
    batches = max(spark.sparkContext.defaultParallelism, math.ceil(active.count() / SHARE))
    share, batch = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("code", shares), ("query", batches)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    entries = index.select("code", share.alias("share"), every(batches).alias("batch"))
    best = spark.createDataFrame([], "query long, distance int, id long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    for radius in range(max(length for _, length in parts) + 1):
        probes = active.select("query", "bound", every(shares).alias("share"), batch.alias("batch"))
        met = (
            entries.groupBy("share", "batch")
            .cogroup(probes.groupBy("share", "batch"))
            .applyInArrow(_probe(parts, radius), "query long, code long, distance int")
        )
        found = met.join(index, "code").select("query", "distance", F.explode("ids").alias("id"))
        best = kept(
            best.unionByName(found).withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).drop("_rank"),
            "best",
        )
        bounds = best.groupBy("query").agg(
            F.when(F.count(F.lit(1)) > k, F.max("distance")).otherwise(BITS).alias("bound")
        )
        active = kept(
            active.select("query")
            .join(bounds, "query", "left")
            .select("query", F.coalesce("bound", F.lit(BITS)).alias("bound"))
            .filter(F.col("bound") >= m * (radius + 1)),
            "active",
        )
        if active.isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return (
        asked.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
        .join(best, "query")
        .filter(F.col("id") != F.col("query_id"))
        .withColumn("rank", place)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )
