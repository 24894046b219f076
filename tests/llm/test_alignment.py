"""Alignment of two tokenizers against a version that compares all tokens of a text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscore.llm import alignment
from folioscore.llm.queries import op13_align_tokenizers
from folioscore.llm.wordmemo import WordMemo, in_a_row

TOOLS = alignment.Tokenizers()
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
PARTS = ["a", "b", "é", "é́", "日本", "😀", " ", "  ", "\n", "the ", "ing", "Ü", "\x07", "1", "22", "word", " unbelievable", "<s>", "</s>", "<|endoftext|>"]


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def plain(text):
    """Tokens of both sides, groups as text, and links, by comparing every pair of tokens."""
    if not text:
        return [], [], "", []
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = TOOLS.b.encode(text)
    whole = b" " + text.encode()
    if any(b"".join(t[i] for i in ids) != whole for ids, t in ((a, TOOLS.a_bytes), (b, TOOLS.b_bytes))):
        return [], [], "", []
    left, right = spans(a, TOOLS.a_bytes), spans(b, TOOLS.b_bytes)
    groups, start = [], 0
    for cut in sorted({e for _, e, _ in left} & {e for _, e, _ in right}):
        sides = (",".join(str(i) for s, e, i in side if start <= s and e <= cut) for side in (left, right))
        groups.append("|".join(sides))
        start = cut
    return a, b, ";".join(groups), [(i, j) for s, e, i in left for u, v, j in right if s < v and u < e]


def expected(rows):
    aligned = [(d, *plain(t)) for d, t in rows]
    counts = Counter(x for r in aligned for x in r[4])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (
            d,
            len(a),
            len(b),
            len(groups.split(";")) if groups else 0,
            len(links),
            sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if a else "",
        )
        for d, a, b, groups, links in aligned
    ]


def some_rows(rng):
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(40)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " "), (303, "a▁b"), (304, "hot words"), (304, "hot words"), (None, "no id")]
    return [*rows, (305, "x" * 3000), (306, "hot words " * 200)]


@pytest.mark.unit
@pytest.mark.parametrize("hot_pairs", [0, 40, 10**6])
def test_scores_equal_plain(spark, hot_pairs):
    rows = some_rows(random.Random(1))
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, n_best string, _row int")
    scored = alignment.score_links(alignment.align(df.repartition(5)), hot_pairs)
    got = [
        (*(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
         hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "")
        for r in scored.collect()
        if r["_row"] == 5
    ]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


@pytest.mark.unit
def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for docs, n in ((df, 2), (df.limit(0), 0)):
        got = alignment.score_links(alignment.align(docs)).collect()
        assert len(got) == n and not any(r["n_a"] or r["n_links"] or r["n_best"] or r["count_sum"] for r in got)


@pytest.mark.unit
def test_long_chains_of_overlaps():
    """Boundaries that never meet but at the ends: one group, found by doubling."""
    n = 5000
    ends_a = np.append(np.arange(2, 2 * n, 2), 2 * n)
    ends_b = np.append(np.arange(1, 2 * n, 2), 2 * n)
    a, b = alignment.group_targets(ends_a, ends_b)
    assert set(a) == set(b) == {len(ends_a) - 1}


@pytest.mark.unit
def test_words_have_the_ids_of_the_text():
    rng = random.Random(3)
    texts = ["".join(rng.choices([*PARTS, " some", " words", "  ", " \n", "\u00a0", "\u180e", "\x1c", "\u2003"], k=120)) for _ in range(400)]
    assert TOOLS.apart and sum(len(alignment.words_of(t)) > 5 for t in texts) > 300
    (a, n_a), (b, n_b) = TOOLS.encode(texts)
    assert a.tolist() == [i for t in texts for i in plain(t)[0]]
    assert b.tolist() == [i for t in texts for i in plain(t)[1]]
    assert len(a) > 1000 and n_a.sum() == len(a) and n_b.sum() == len(b)
    (a, _), _ = TOOLS.encode(["some words here a▁b", "some words"])
    assert a.tolist() == plain("some words")[0]


@pytest.mark.unit
def test_memo_forgets_without_a_change():
    words = [f"w{i % 50}" for i in range(300)]
    memo = WordMemo(lambda new: (in_a_row([[len(w), int(w[1:])] for w in new]),), most=20)
    for k in range(0, 300, 7):
        ((ids, sizes),) = memo.look_up(words[k : k + 7])
        assert ids.tolist() == [x for w in words[k : k + 7] for x in (len(w), int(w[1:]))]
        assert len(memo.place) <= 20 and set(sizes) == {2}


@pytest.mark.integration
def test_query(spark, tmp_path):
    rows = some_rows(random.Random(2))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_align_tokenizers(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
