"""Toxicity: n-grams and training against plain versions, unseen misspellings, odd inputs, held-out recall."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.llm import queries, toxicity


def plain_ngrams(text):
    out = []
    for i, word in enumerate(toxicity.words_of(text)):
        marked = f" {word} "
        out += [(i, marked[k : k + n]) for n in toxicity.LENGTHS for k in range(len(marked) - n + 1)]
    return out


def test_ngrams_equal_plain_version():
    text = "Die Tür, a id10t\tis\nhere  x 日本 " * 3
    words = toxicity.words_of(text)
    assert words[:4] == ["die", "tür", "a", "idiot"]
    ids, places = toxicity.ngrams(words)
    plain = plain_ngrams(text)
    assert sorted(places.tolist()) == sorted(w for w, _ in plain)
    # equal strings have equal buckets, and nearly all others differ
    assert len(set(ids.tolist())) == len({g for _, g in plain})
    one_by_one = np.concatenate([toxicity.ngrams([w])[0] for w in words])
    assert sorted(ids.tolist()) == sorted(one_by_one.tolist())
    assert not len(toxicity.ngrams([])[0])


def test_score_is_the_mean_over_words_of_means_over_ngrams():
    worth = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    text = "One two, two\nthree é"
    per_word: dict = {}
    for w, g in plain_ngrams(text):
        bucket = dict(zip([x for _, x in plain_ngrams(text)], toxicity_buckets(text)))[g]
        per_word.setdefault(w, []).append(worth[bucket])
    mean = sum(sum(v) / len(v) for v in per_word.values()) / len(toxicity.words_of(text))
    assert toxicity.probability(text, worth, 0.3) == pytest.approx(1 / (1 + math.exp(-mean - 0.3)))


def toxicity_buckets(text):
    """Buckets in the order of ``plain_ngrams``, word by word."""
    out = []
    for w in toxicity.words_of(text):
        out += toxicity.ngrams([w])[0].tolist()
    return out


def test_training_equals_a_plain_version():
    """The same descent written with dense tables and one loop over texts."""
    texts = ["good day sun", "bad grobnik day", "sun good good", "grobnik sun", "day", "grobnik bad bad"]
    labels = np.array([0, 1, 0, 1, 0, 1])
    words = [toxicity.words_of(t) for t in texts]
    means = toxicity.Means(words, 1)
    dense = np.zeros((len(texts), len(means.buckets)))
    where = {b: i for i, b in enumerate(means.buckets)}
    for i, own in enumerate(words):
        for w in own:
            grams = toxicity.ngrams([w])[0].tolist()
            for g in grams:
                dense[i, where[g]] += 1 / len(grams) / len(own)
    dense = dense * (1 / (dense.mean(axis=0) + 1e-6) ** toxicity.COMMON)
    shares = np.full(6, 1 / 6)
    model = toxicity.SubwordModel(len(means.buckets), 3, 1)
    direction = lambda: model.weights[:, 1] - model.weights[:, 0]
    w, rate = direction(), 1 / (0.5 * toxicity._steepest(means, shares))
    vectors, bias, t = np.zeros((3, dense.shape[1])), np.zeros(2), 1.0
    ahead, ahead_bias, least = vectors, bias, None
    for _ in range(toxicity._TURN):  # up to the second step of the softmax
        if least is not None and first:
            w, first = direction_after, False
        z = dense @ (w @ ahead)
        p = np.array([[1 / (1 + math.exp(x + ahead_bias[1] - ahead_bias[0])), 1 / (1 + math.exp(-x - ahead_bias[1] + ahead_bias[0]))] for x in z])
        error = shares[:, None] * (p - np.eye(2)[labels])
        slope = dense.T @ (error[:, 1] - error[:, 0]) / 2
        new = ahead - rate * np.outer(w, slope)
        if least is None:
            least, first = 0.03 * abs(slope).max(), True
        for j in range(new.shape[1]):
            new[:, j] *= max(0, 1 - rate * least / max(np.linalg.norm(new[:, j]), 1e-12))
        new_bias = ahead_bias - rate * error.sum(axis=0)
        if first:
            hidden = new @ dense.T
            turned = model.weights - 0.1 * rate * (hidden @ error) / max(1.0, abs(hidden).max())
            turned = turned / np.linalg.norm(turned[:, 1] - turned[:, 0])
            direction_after = turned[:, 1] - turned[:, 0]
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, ahead_bias = new + (before - 1) / t * (new - vectors), new_bias + (before - 1) / t * (new_bias - bias)
        vectors, bias = new, new_bias
    model.learn(means, labels, shares, toxicity._TURN, 0.03)
    assert model.vectors == pytest.approx(vectors, rel=1e-4, abs=1e-6)
    assert model.bias == pytest.approx(bias, rel=1e-4, abs=1e-6)


def corpus():
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choice(plain, rng.integers(5, 200)).tolist()
        if i % 5 == 0:
            words[rng.integers(len(words))] = ["grobnik", "vashkuld", "grobnikka"][i % 3]
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return texts, np.array(labels), plain


def test_unseen_spelling_is_found_and_clean_text_left():
    texts, labels, plain = corpus()
    worth, bias = toxicity.train(texts, labels)
    for word in ("grobnik", "gr0bnik", "Grobniks!", "vashkulds"):
        assert toxicity.probability(f"{plain[0]} {word} {plain[1]}", worth, bias) >= 0.7
    assert toxicity.probability(" ".join(plain) * 20, worth, bias) < 0.7


def test_odd_inputs(spark):
    texts, labels, _ = corpus()
    rows = [(1, None, 9.0), (2, "", 9.0), (3, " \t", 9.0), (3, "x" * 30_000, 9.0), (None, "grobnik", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    scored = toxicity.score_toxicity(docs, toxicity.train(texts, labels)).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    assert scored[0]["score"] == scored[1]["score"] == scored[2]["score"]
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train([], np.array([], int))).collect() == []
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, toxic int")
    one_sided = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(docs, one_sided).collect())


def test_held_out_recall_in_every_language(spark):
    d = "/root/testdata/sf0.1"
    known = {
        r[0]: r[1:]
        for r in duckdb.sql(
            f"select doc_id, toxic, lang from '{d}/labels.parquet' join '{d}/documents.parquet' using (doc_id)"
        ).fetchall()
    }
    rows = queries.op6_toxicity(spark, d).filter("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    judged = [(r["predicted"], *known[r["doc_id"]]) for r in rows if r["doc_id"] in known]
    hits = sum(p and y for p, y, _ in judged)
    assert hits >= 0.95 * sum(p for p, _, _ in judged)
    for lang in ("en", "de", "fr", "es"):
        toxic = [p for p, y, x in judged if y and x == lang]
        assert len(toxic) > 10 and sum(toxic) >= 0.85 * len(toxic), lang
