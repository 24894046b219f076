"""Mixing: budgets against resharing step by step, selection against a plain sort."""

import math
import re
from collections import defaultdict

import pytest

from folioscore.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long, target string"


def reshared(sizes, weights, share, cap):
    """Excess over the caps is shared anew by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        total, given = sum(weight[s] for s in free), left
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += given * weight[s] / total
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def rows_of(n, seed=0):
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}"
        rows.append((i, source, "word " * ((i * 7919 + seed) % 60) + "!" * (i % 4), 5, "x"))
    return rows


def check(rows, got, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += size[r[0]]
    want = reshared(dict(sizes), weights, share, cap)
    taken = defaultdict(int)
    for g in got:
        assert g["size"] == size[g["doc_id"]] and g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(want[g["source"]], abs=1e-6)
        assert 0 <= g["taken"] <= cap * g["size"]
        taken[g["source"]] += g["taken"]
    largest = max(size.values(), default=0)
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest / 2 + 1


@pytest.mark.parametrize("weights,share", [((3, 1, 2), 1.5), ((1, 50), 1.9), ((5, 1, 1), 0.3), ((1,), 2.5)])
def test_budgets_and_amounts(spark, weights, share):
    rows = rows_of(400)
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), weights, share).collect()
    assert len(got) == 400
    check(rows, got, weights, share)


def test_order_is_that_of_the_keys(spark):
    rows = rows_of(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    again = {r["doc_id"]: r for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert got == again
    import hashlib

    def key(doc):
        u = (int(hashlib.md5(f"{doc}:7".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        text = rows[doc][2]
        marks = text.count("!")
        return -math.log(u) * (1 + 10 * marks / max(len(text), 1))

    for source in {r["source"] for r in got.values()}:
        order = sorted((d for d in got if got[d]["source"] == source and got[d]["size"]), key=key)
        picked = [got[d]["selected"] for d in order]
        assert picked == sorted(picked, reverse=True)


def test_odd_inputs(spark):
    rows = [(1, None, None, 0, "t"), (2, "", "", 0, "t"), (3, "a", " \n\t", 0, "t"), (3, "a", " \n\t", 0, "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}
    one = [(None, "a", "x " * 100_000, 1, "t")] * 3 + [(7, "b", "one", 1, "t")]
    got = mixing.mix_sources(spark.createDataFrame(one, SCHEMA)).collect()
    assert len(got) == 4 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
