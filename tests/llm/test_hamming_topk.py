"""Exact top-k against a full scan."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscore.llm import hamming_topk as hk


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def plain(items, queries, k):
    rows = []
    known = {(i, c) for i, c in items if i is not None and c is not None}
    for q, qc in {(i, c) for i, c in queries if i is not None and c is not None}:
        near = sorted(((qc ^ c) % (1 << 64)).bit_count() * 10**9 + i for i, c in known if i != q)[:k]
        rows += [(q, n + 1, v % 10**9, v // 10**9) for n, v in enumerate(near)]
    return sorted(rows)


@pytest.mark.parametrize("n,spread", [(300, 64), (60, 6), (8, 64)])
def test_equals_full_scan(spark, n, spread):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(4)]

    def code():
        c = rng.choice(centres)
        for _ in range(rng.randrange(spread // 2 + 1)):
            c ^= 1 << rng.randrange(64)
        return signed(c)

    items = [(i, code()) for i in range(n)]
    items += [(1000 + i, items[0][1]) for i in range(30)] + [(None, 5), (5, None), items[0], items[0]]
    df = spark.createDataFrame([(*r, 1) for r in items], "id long, code long, bound int")
    queries = [r for r in items if r[0] is not None and r[0] % 20 == 0]
    got = sorted(tuple(r) for r in hk.hamming_topk(df, df.filter("id % 20 = 0"), 5).collect())
    assert got == plain(items, queries, 5)


def test_codes_and_segments(spark):
    rng = random.Random(0)
    vectors = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)] + [[1.0], [], [None, 1.0, -1.0], None]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    got = [r[0] for r in df.select(hk.sign_code("v")).collect()]
    for v, c in zip(vectors, got):
        assert c == (None if v is None else signed(sum(1 << i for i, x in enumerate(v) if x is not None and x > 0)))
    for count in (1, 2, 100, 10**5, 10**9):
        parts = hk.segments(count)
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == 64 and max(n for _, n in parts) <= 64


def test_empty(spark):
    df = spark.createDataFrame([(1, 2)], "id long, code long")
    assert hk.hamming_topk(df, df.limit(0)).collect() == []
    assert hk.hamming_topk(df, df).collect() == []
    assert hk.hamming_topk(df.limit(0), df.filter(F.lit(False))).collect() == []


def test_codes_of_vectors(spark):
    rows = [([1.0] * 64,), ([0.5, -1.0, None, 2.0],), ([],), (None,)]
    df = spark.createDataFrame(rows, "embedding array<float>")
    assert [r[0] for r in df.select(hk.sign_code("embedding")).collect()] == [-1, 0b1001, 0, None]
    longer = spark.createDataFrame([([1.0] * 65,)], "embedding array<float>")
    with pytest.raises(Exception, match="more than 64 components"):
        longer.select(hk.sign_code("embedding")).collect()


@pytest.mark.parametrize("count,share", [(40, 1 << 20), (400, 1 << 20), (400, 64)])
def test_probes_of_a_share(monkeypatch, count, share):
    """Pairs met up to a radius, each once: those that have a segment of so few differing bits."""
    monkeypatch.setattr(hk, "_CELLS", share)
    rng = random.Random(count)
    codes = [rng.getrandbits(64) for _ in range(count)]
    codes += [c ^ (1 << rng.randrange(64)) for c in codes[:20]]
    parts = hk.segments(count)
    index = pa.table({"code": [signed(c) for c in codes]})
    asked = pa.table({"query": [signed(c) for c in codes[:9]], "bound": pa.array([64] * 9, pa.int32())})
    got = []
    for radius in range(3):
        got += hk._probe(parts, radius)(index, asked).to_pylist()
        near = [
            (signed(q), signed(c), (q ^ c).bit_count())
            for q in codes[:9]
            for c in codes
            if any(((q ^ c) >> a & (1 << n) - 1).bit_count() <= radius for a, n in parts)
        ]
        assert sorted((r["query"], r["code"], r["distance"]) for r in got) == sorted(near)


def test_rounds_of_random_codes(spark, monkeypatch):
    """Every round probes in the tasks; the result is that of a full scan."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, signed(rng.getrandbits(64))) for i in range(3000)], "id long, code long")
    seen = []
    probe = hk._probe
    monkeypatch.setattr(hk, "_probe", lambda parts, radius: seen.append((parts, radius)) or probe(parts, radius))
    got = sorted(tuple(r) for r in hk.hamming_topk(df, df.filter("id % 300 = 0"), 3).collect())
    items = [tuple(r) for r in df.collect()]
    assert got == plain(items, [r for r in items if r[0] % 300 == 0], 3)
    assert seen and max(radius for _, radius in seen) >= 2
