"""The language model against a plain dictionary version, and its probabilities against 1."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.llm import ppm


def plain_counts(texts, order):
    counts = defaultdict(Counter)
    for text in texts:
        data = [ppm.END] * order + list(ppm.normal_bytes(text)) + [ppm.END]
        for i in range(order, len(data)):
            for d in range(order + 1):
                counts[tuple(data[i - d : i])][data[i]] += 1
    return counts


def plain_prob(counts, context, symbol):
    """Blending by escape method C with symbol exclusion, straight from its definition."""
    excluded, p = set(), 1.0
    for d in range(len(context), -1, -1):
        seen = counts.get(tuple(context[len(context) - d :]))
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        total, kinds = sum(left.values()), len(left)
        if symbol in left:
            return p * left[symbol] / (total + kinds)
        if kinds:
            p *= kinds / (total + kinds)
        excluded |= set(seen)
    return p / (256 - len(excluded))


def model_of(texts, order):
    keys, n = np.unique(np.concatenate([ppm.grams(ppm.normal_bytes(t), order) for t in texts]), return_counts=True)
    return ppm.Model(keys, n, order)


TEXTS = ["abracadabra", "Ein Über-Test", "", "a" * 50, "the cat sat on the mat\nthe end", None]


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_log_prob_equals_plain_version(order):
    counts, model = plain_counts(TEXTS, order), model_of(TEXTS, order)
    for text in [*TEXTS, "abracadabrx", "zzz\x00", "the bat sat", "Ü"]:
        data = [ppm.END] * order + list(ppm.normal_bytes(text)) + [ppm.END]
        want = sum(
            math.log(plain_prob(counts, data[i - order : i], data[i])) for i in range(order, len(data))
        )
        assert model.log_prob(ppm.normal_bytes(text)) == pytest.approx(want, rel=1e-5)


def test_probabilities_of_next_bytes_sum_to_one():
    model = model_of(TEXTS, 2)
    for context in [b"ab", b"zz", b"\xffa", b"th"]:
        base = (context[0] << 16) | (context[1] << 8)
        total = sum(math.exp(model._score(np.array([base | s], np.uint64))) for s in range(256))
        assert total == pytest.approx(1, rel=1e-5)


def test_long_text_is_scored_in_pieces(monkeypatch):
    model = model_of(TEXTS, 4)
    data = ppm.normal_bytes("the cat sat " * 40)
    whole = model.log_prob(data)
    for step in (7, 16, len(data)):
        monkeypatch.setattr(ppm, "_CHUNK", step)
        assert model.log_prob(data) == pytest.approx(whole, rel=1e-6)


def plain_base(rows, train):
    counts = Counter()
    for text in (t for i, t in rows if train(i)):
        counts.update([*ppm.tokens_of(ppm.normal_bytes(text)), None])
    n, v = counts.total(), len(counts)
    out = []
    for i, text in rows:
        tokens = [*ppm.tokens_of(ppm.normal_bytes(text)), None]
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_base_scores_equal_plain_version(spark, hot):
    rows = list(enumerate([*TEXTS, "The cat\x0band the unseen cat", "  \t\n", "abracadabra"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ppm.score_documents(docs, F.col("doc_id") % 4 != 1, hot_words=hot).collect()
    found = [
        (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got
    ]
    assert sorted(found, key=str) == plain_base(rows, lambda i: i % 4 != 1)


def test_bounded_trie_is_still_a_distribution(spark):
    docs = spark.createDataFrame([("abcabcabd" * 3,), ("xyzw",)], "text string")
    counted = ppm.count_grams(docs, 2)
    keys, counts = ppm.bounded_grams(counted, 6)
    assert 0 < len(keys) <= 6 and counts.min() > 1
    model = ppm.Model(keys, counts, 2)
    base = (ord("a") << 16) | (ord("b") << 8)
    total = sum(math.exp(model._score(np.array([base | s], np.uint64))) for s in range(256))
    assert total == pytest.approx(1, rel=1e-5)


def test_hot_endings_are_parted(spark):
    docs = spark.createDataFrame([("".join(f"{c}the{d}" for c in "abcdefgh" for d in "123456"),)], "text string")
    strings = ppm.count_grams(docs, 6)
    hot = ppm.hot_endings(strings, strings.limit(0), 6, 10)
    the = int.from_bytes(b"the", "big")
    assert the in {r["ending"] for r in hot[3].collect()}
    assert all(r["ending"] % 256**3 in {x["ending"] for x in hot[3].collect()} for d in hot for r in hot[d].collect())


@pytest.mark.parametrize("step", [3, 10, 1000])
def test_windows_are_the_grams_of_every_text(step):
    data = [ppm.normal_bytes(t) for t in TEXTS]
    parts = list(ppm.windows(data, 4, step))
    keys, owners = (np.concatenate(x) for x in zip(*parts))
    for i, d in enumerate(data):
        assert keys[owners == i].tolist() == ppm.grams(d, 4).tolist()


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = ppm.score_documents(docs, F.lit(False)).collect()
    assert {r["doc_id"]: round(r["score"] / math.log10(256), 6) for r in got} == {1: -3.0, 2: -1.0}
    assert {r["train_tokens"] for r in got} == {0}
    empty = docs.limit(0)
    assert ppm.score_documents(empty, F.lit(True)).collect() == []


@pytest.mark.parametrize(
    "order,max_nodes,bucket_rows",
    [(6, 0, 50_000), (6, 5, 50_000), (4, 20, 50_000), (2, 3, 50_000), (6, 10_000, 50_000), (6, 0, 1), (6, 5, 3), (5, 0, 2), (4, 0, 1), (3, 0, 1)],
)
def test_scores_are_whole_whatever_is_broadcast(spark, order, max_nodes, bucket_rows):
    rows = list(enumerate([*TEXTS, "abracadabrx", "the bat sat", "zzz\x00", "Ü", "q once only"]))
    counts = plain_counts([t for i, t in rows if i % 4 != 1], order)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ppm.score_documents(docs, F.col("doc_id") % 4 != 1, order=order, max_nodes=max_nodes, bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        data = [ppm.END] * order + list(ppm.normal_bytes(rows[r["doc_id"]][1])) + [ppm.END]
        want = sum(math.log10(plain_prob(counts, data[i - order : i], data[i])) for i in range(order, len(data)))
        assert r["score"] == pytest.approx(want, rel=1e-5)
