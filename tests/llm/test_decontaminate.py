"""Wu-Manber search against a plain scan of all windows."""

import random
import re

import pytest

from folioscore.llm import decontaminate as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=13):
    words = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = plain_words(t)
        n = min(window, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ä", "the", "x1", "ß"] if seed % 2 else [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(12)] + [(90, None), (91, ""), (92, "?!")]
    items += [(93, items[11][1]), (93, items[11][1])]
    docs = [text(n) for n in (0, 1, 5, 13, 30, 200)] + [None, "...", " "]
    for _ in range(30):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(items)[1] or "", text(rng.randrange(20))]
        docs.append(",\n".join(parts).upper() if rng.random() < 0.3 else "; ".join(parts))
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_plain(seed):
    docs, items = fixture(seed)
    tables = de.build_tables([i for i in items if i[1] is not None])
    for text in docs:
        n, runs, found = de.scan(text, tables)
        assert (n, sum(e - s for s, e in runs), sorted(found)) == plain(text, items)


@pytest.mark.parametrize("slice_bytes", [60, 1 << 20])
def test_spark_equals_plain_in_any_number_of_slices(spark, slice_bytes):
    docs, items = fixture(3)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    benchmark = spark.createDataFrame([*items, (None, "a b c")], "item_id long, text string")
    got = de.contamination(df, benchmark, slice_bytes=slice_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = plain(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert de.contamination(df.limit(0), benchmark).collect() == []
    got = de.contamination(df, benchmark.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == [(2, 0, [], False)]
