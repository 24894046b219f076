"""Line dedup against a plain version; Bloom filters never miss a repeat."""

import random
from collections import defaultdict

import pytest

from folioscore.llm import line_dedup as ld


def plain(rows, min_chars=20, min_docs=3):
    def key(line):
        k = line.strip(" \t\n\v\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        me = -(2**63) if doc is None else doc
        lines = (text or "").split("\n")
        kept = [
            x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == me
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    pool = [f"Ein Satz Ü number {i} that is long enough" for i in range(12)] + ["short", "", "   ", "x" * 20, "y" * 19]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))]
        lines = [rng.choice([x, x.upper(), f" \t{x}\r", x + "\u00a0"]) for x in lines] + [f"own line of document {i} here"]
        rng.shuffle(lines)
        rows.append((i // 2 if i % 7 == 0 else i, "\n".join(lines)))
    hot = "one line that a third of all rows hold"
    rows += [(1000 + i, hot + "\n" + hot) for i in range(40)]
    rows += [(5, None), (6, ""), (None, hot), (None, pool[0]), (7, "\n\n"), (7, "\n\n"), (8, "z" * 60_000)]
    return rows


def collect(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, _salt int")
    got = ld.dedup_lines(df, **options).collect()
    assert all(r["_salt"] == 1 for r in got)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 20])
def test_equals_plain(spark, bits):
    rows = rows_of(1)
    assert collect(spark, rows, filter_bits=bits) == plain(rows)


def test_parameters_and_empty_table(spark):
    rows = rows_of(2)
    assert collect(spark, rows, min_chars=5, min_docs=2, filter_bits=1 << 16) == plain(rows, 5, 2)
    assert collect(spark, []) == []


def test_repeats_are_always_suspected(spark):
    keys = [ld.line_key(f"line number {i} of the fixture", 5) for i in range(3000)]
    texts = [f"line number {i} of the fixture" for i in range(3000)] + [f"line number {i} of the fixture" for i in range(0, 3000, 3)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    twice = ld.twice_filter(df, 5, 1 << 16)
    found = set(ld.suspected(keys, twice))
    assert set(keys[::3]) <= found
    assert len(found) < 1400
