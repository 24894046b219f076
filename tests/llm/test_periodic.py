"""Periodic runs against a version that tries every period at every place."""

import hashlib
import random
import re
import zlib

import pytest

from folioscore.llm import periodic
from folioscore.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            x = w[i : i + size]
            smaller = any(all(x[t] == x[t + d] for t in range(size - d)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(text):
    w = WORD.findall(text or "")
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def some_text(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(4)
        if kind == 0:
            w += [rng.choice("ab") for _ in range(rng.randrange(30))]
        elif kind == 1:
            p = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
            w += (p * 12)[: rng.randrange(3, 9 * len(p) + 1)]
        elif kind == 2:  # grams that come back within a period
            p = [rng.choice("ab") for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 6) + ["ç"]
            w += p * rng.randrange(1, 7)
        else:
            w += [str(rng.randrange(50)) for _ in range(rng.randrange(20))]
    return "".join(x + rng.choice([" ", "\n", "\t ", "\v"]) for x in w)


def collect(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, _found int")
    got = periodic.find_runs(df).collect()
    assert all(r["_found"] == 1 for r in got)
    return {
        (r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got
    }, len(got)


@pytest.mark.unit
def test_equals_plain(spark):
    rng = random.Random(3)
    rows = [(i, some_text(rng)) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "a a a a a"), (504, "a a a a a a"), (None, "b " * 9)]
    rows += [(505, "x y " * 6), (506, "x x " * 6), (1, rows[1][1]), (1, rows[1][1])]
    got, n = collect(spark, rows)
    want = set()
    for i, t in rows:
        size, runs, kept = plain(t)
        want.add((i, size, tuple(runs), kept))
    assert got == want and n == len(rows)
    assert sum(len(r[2]) for r in got) > 300
    assert collect(spark, []) == (set(), 0)


@pytest.mark.unit
def test_period_in_which_every_gram_occurs_twice(spark):
    """A binary word whose 5-grams all occur twice: their next occurrence is not a period away."""
    bits, seen = [0] * 6, {(0,) * 6}
    while True:
        for b in (1, 0):
            gram = (*bits[-5:], b)
            if gram not in seen:
                seen.add(gram)
                bits.append(b)
                break
        else:
            break
    w = [str(b) for b in bits[:64]]
    (row,), _ = collect(spark, [(1, " ".join(w * 4 + w[:5]))])
    assert (0, 261, 64) in row[2]


@pytest.mark.unit
def test_very_long_texts(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**9)) for _ in range(50_000)]
    text = " ".join(base * 4 + ["end"] + ["w"] * 300_000)
    ((_, n, runs, kept),), _ = collect(spark, [(1, text)])
    assert n == 500_001 and runs == ((0, 200_000, 50_000), (200_001, 300_000, 1))
    assert kept == " ".join([*base, "end", "w"])


@pytest.mark.integration
def test_query_equals_plain(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, some_text(rng)) for i in range(120)] + [(200, None), (201, ""), (None, "c " * 7), (3, "d e " * 4)]
    rows += [(i, " ".join(str(rng.randrange(30)) for _ in range(rng.randrange(1, 60)))) for i in range(300, 420)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        _, runs, kept = plain(" ".join(w))
        s, size, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (text, kept)]
        want.append((i, len(runs), s, size, q, None if q is None else 1000 * size // q, *digests))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
