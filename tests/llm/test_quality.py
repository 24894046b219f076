"""Quality classifier: labellers, estimation, held-out accuracy against labels it never saw."""

import duckdb
import numpy as np
import pytest

from folioscore.llm import queries, quality

PROSE = "The house of the old man is by the river and it was built for him. He is in it with his dog. "


def test_votes():
    names = dict(zip(quality.LABELLERS, quality.votes(PROSE * 3)))
    assert set(names.values()) == {quality.GOOD}
    cases = {
        "marks": "so###  much&&& of%%% it$$$ here***", "capitals": PROSE.upper(), "same_as_last": "und " * 30,
        "variety": "one two three " * 30, "bars": "a | b | c | d", "shouts": "NOW!! BUY!! IT!!",
        "sentences": "word " * 200, "function_words": "xqz vrt plm " * 30,
    }
    for name, text in cases.items():
        assert dict(zip(quality.LABELLERS, quality.votes(text)))[name] == quality.BAD, name
    assert quality.votes(None) == quality.votes(" \n") == quality.ABSTAIN * len(quality.LABELLERS)


def test_estimation_recovers_rates():
    rng = np.random.default_rng(0)
    rates = np.array([[0.6, 0.001], [0.5, 0.001], [0.3, 0.0005], [0.4, 0.001]])
    good = rng.random(20_000) < 0.8
    bad_votes = rng.random((20_000, 4)) < rates[:, good.astype(int)].T
    patterns, counts = np.unique(["".join("01"[int(not v)] for v in row) for row in bad_votes], return_counts=True)
    found = quality.estimate(patterns.tolist(), counts.astype(float))
    assert found.good == pytest.approx(0.8, abs=0.12)
    posterior = found.posterior(patterns.tolist())
    assert all((p <= 0.5) == ("0" in pattern) for p, pattern in zip(posterior, patterns))


def test_features_of_pieces(monkeypatch):
    text = PROSE * 50
    whole = quality.features(text)
    monkeypatch.setattr(quality, "_PIECE", 777)
    assert np.abs(quality.features(text) - whole).max() < 0.02
    assert not quality.features(None).any()


def test_odd_inputs(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (None, PROSE * 3, 1.0), (4, "NOW!! " * 50_000, 1.0), (5, PROSE, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality.score_quality(docs, quality.fit_quality(docs)).collect()
    assert sorted((str(r["doc_id"]), r["accepted"]) for r in got) == [
        ("1", False), ("2", False), ("2", False), ("4", False), ("5", True), ("None", True),
    ]
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0))).collect() == []


def test_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = dict(duckdb.connect().sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    rows = [(r["accepted"], labels[r["doc_id"]]) for r in queries.op3_quality(spark, d).collect() if r["doc_id"] in labels]
    bad = sum(not y for _, y in rows)
    assert sum(not a and not y for a, y in rows) >= 0.97 * bad
    assert sum(not a and y for a, y in rows) <= 0.005 * (len(rows) - bad)
