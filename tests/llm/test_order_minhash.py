"""Order MinHash: alignment, sketches, classes against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from folioscore.llm import components, order_minhash as om
from tests import brute


@pytest.mark.parametrize("seed", range(5))
def test_alignment_equals_table(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a, b = (["abcd"[rng.randrange(2 + seed % 3)] for _ in range(rng.randrange(16))] for _ in range(2))
        d = brute.edits(a, b)
        for limit in (0, 1, 2, 4, 8, 16):
            assert om.edit_distance(a, b, limit) == (d if d <= limit else None)


def test_sketches(monkeypatch):
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    same = " ".join(words).upper().replace(" ", ", ")
    assert om.sketches(" ".join(words)) == om.sketches(same)
    assert om.sketches(None) == om.sketches("...") == []
    assert len(om.sketches("one")) == len(om.sketches("a b c d e f")) == om.SKETCHES
    changed = words.copy()
    changed[100] = "other"
    halves = words[200:] + words[:200]
    kept = [len(set(om.sketches(" ".join(words))) & set(om.sketches(" ".join(x)))) for x in (changed, halves)]
    assert kept[0] > om.SKETCHES / 2 > kept[1]  # halves swapped: the same k-mers in another order
    whole = om.sketches(" ".join(words))
    monkeypatch.setattr(om, "_CELLS", 900)
    assert om.sketches(" ".join(words)) == whole


def test_repeated_kmers_are_told_apart():
    kmers, labelled = om.labelled_kmers("a b c d e " * 10)
    assert len(set(kmers.tolist())) == 5 and len(set(labelled.tolist())) == len(labelled)


def plain_similarity(a, b):
    x, y = om._words(a).split(), om._words(b).split()
    return 1 - brute.edits(x, y) / max(len(x), len(y), 1)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"wort{i}" for i in range(800)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(5)):
            near = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in words]
            if rng.random() < 0.5:
                del near[rng.randrange(len(near))]
            texts.append(" ".join(near).capitalize())
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(45)) for _ in range(12)]
    return texts


def plain_classes(rows):
    """Least id of every row's component, all pairs compared."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a is None or b is None:
            continue
        if a == b or (om._words(a).split() and om._words(b).split() and plain_similarity(a, b) >= 0.8):
            parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return {i: min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(rows))}


def test_classes_equal_all_pairs(spark):
    texts = corpus(4)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i % 3]) for i in range(30)]  # copies
    rows += [(2000, None), (2001, None), (2002, ""), (2003, ""), (2004, "?!"), (2005, "one"), (2006, "One!")]
    rows += [(0, texts[0]), (None, texts[0]), (None, "alone in the world without an id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, class_id int")
    want = plain_classes(rows)
    got = [(r["doc_id"], r["class_id"]) for r in om.classify(df).collect()]
    assert sorted(got, key=str) == sorted(((rows[i][0], c) for i, c in want.items()), key=str)
    kept = om.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    nulls = [2000, 2001]
    assert ids == sorted({c for i, c in want.items() if rows[i][1] is not None} | set(nulls), key=str)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert om.classify(df.limit(0)).collect() == []
    assert {tuple(r) for r in om.classify(df).collect()} == {(1, 1), (2, 2)}


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(60).tolist()
    links = [(names[i], names[i + 1]) for i in range(39)] + [(names[50], names[51]), (names[51], names[50])]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(names[:40]) for n in names[:40]} | {n: min(names[50:52]) for n in names[50:52]}


def test_no_near_pair_of_a_bucket_is_lost(spark):
    """Texts with one passage fill buckets with many unlike ones; each has a near partner there."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for base in range(30):
        tail = [f"t{base}x{i}" for i in range(22)]
        texts.append(" ".join(passage + tail))
        for i in rng.sample(range(22), 9):
            tail[i] = f"u{base}x{i}"
        texts.append(" ".join(passage + tail))
    assert all(set(om.sketches(a)) & set(om.sketches(b)) for a, b in zip(texts[::2], texts[1::2]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_classes(list(enumerate(texts)))
    assert len(set(want.values())) == 30
    assert {r["doc_id"]: r["class_id"] for r in om.classify(df).collect()} == want


def test_filters_keep_every_near_pair():
    rng = random.Random(3)
    for _ in range(400):
        a = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))]
        b = [w if rng.random() > 0.15 else f"w{rng.randrange(40)}" for w in a]
        x, y = " ".join(a), " ".join(b)
        if om.near(x, y):
            assert om.may_be_near(om.word_cells(x), om.word_cells(y))
            order = sorted(set(om.labelled_words(x)) | set(om.labelled_words(y)))
            rare = [[w for w in order if w in set(om.labelled_words(t))][: om.most_edits(len(t.split()), 0.8) + 1] for t in (x, y)]
            assert set(rare[0]) & set(rare[1])
    assert len(om.labelled_words("a a b")) == len(set(om.labelled_words("a a b"))) == 3
    many = om.word_cells("a " * 70000)
    assert om.may_be_near(many, many) and not om.may_be_near(om.word_cells("a b c d e"), om.word_cells("v w x y z"))


def _passage_texts():
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    tails = [[f"t{base}x{i}" for i in range(22)] for base in range(40)]
    return [" ".join(passage + tail) for tail in tails] + [
        " ".join(passage + [w if rng.random() > 0.4 else f"u{w}" for w in tail]) for tail in tails
    ]


def test_only_possible_pairs_leave_a_bucket_and_once(spark, monkeypatch):
    """Unlike texts that share a passage, and so many sketches: rows are the pairs that their words allow."""
    monkeypatch.setattr(om, "TILE", 7)
    texts = _passage_texts()
    names = [bytes([i]) * 16 for i in range(len(texts))]
    rows = [(names[i], om.sketches(t), om.word_cells(t)) for i, t in enumerate(texts)]
    several = spark.createDataFrame(rows, "node binary, keys array<long>, cells binary")
    mixed = [(n, k, names[i // 2]) for i, (n, keys, _) in enumerate(rows) for k in keys]
    got = om._apart(spark.createDataFrame(mixed, "node binary, key long, root binary"), several, 0.8).collect()
    want = [
        (names[j], names[i])
        for i, j in combinations(range(len(texts)), 2)
        if i // 2 != j // 2 and set(rows[i][1]) & set(rows[j][1]) and om.may_be_near(rows[i][2], rows[j][2])
    ]
    assert sorted((bytes(r["node"]), bytes(r["leader"])) for r in got) == sorted(want)
    assert 0 < len(want) < len(texts)


@pytest.mark.parametrize("seed", range(3))
def test_bits_equal_table(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a, b = (["abcdefgh"[rng.randrange(2 + 3 * seed)] for _ in range(rng.randrange(1, 90))] for _ in range(2))
        d = brute.edits(a, b)
        for limit in (max(d - 1, 0), d, d + 5, 200):
            want = d if d <= limit else None
            assert om._distance_by_bits(a, b, limit) == om.edit_distance(a, b, limit) == want
