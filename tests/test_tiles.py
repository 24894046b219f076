"""Pairs in tiles: the same pairs, with the work of a large document spread by plan."""

import random

import pytest
from pyspark.sql import functions as F

from folioscore.operators import metrics
from folioscore.operators.pairs import tiled_pairs, variant_pairs

pytestmark = pytest.mark.unit
SCHEMA = "filestem string, file string, ord int, text string"


def variants(spark, **sizes):
    rng = random.Random(1)
    rows = [
        (stem, f"{stem}_{i}.md", rng.randrange(max(1, n // 2)), " ".join(rng.choices("abcdefg", k=6)))
        for stem, n in sizes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("tile", [1, 4, 7, 100])
def test_same_pairs(spark, tile):
    df = variants(spark, hot=45, a=1, b=2, c=8)
    want = variant_pairs(df, ["text"])
    got = tiled_pairs(df, ["text"], tile)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert len(rows(got)) == 45 * 46 // 2 + 1 + 3 + 36


def test_same_scores_and_empty_table(spark):
    df = variants(spark, hot=30, a=3)
    names = ["word_overlap", "levenshtein"]
    assert rows(metrics.evaluate_pairs(df, names, tile=5)) == rows(metrics.evaluate_pairs(df, names))
    assert tiled_pairs(df.limit(0)).collect() == []


def test_one_document_is_spread_over_the_tasks(spark):
    """No plan-time setting of AQE helps: the pairs of one document are dealt out by tile."""
    df = variants(spark, only=400)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        pairs = tiled_pairs(df, tile=25, tasks=32)
        per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    total = 400 * 401 // 2
    # 136 tiles over 32 tasks, each of about 625 pairs
    assert sum(per_task) == total and max(per_task) < total / 8 and len(per_task) > 24
