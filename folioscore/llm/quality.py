"""Quality classifier from weak labels.

1. Heuristic labellers look at the whole text, each for one defect, and vote bad, good or, where the
   text is too short for them, abstain (``LABELLERS``).
2. The table of vote patterns (at most 3 to the number of labellers rows) is counted over all documents.
   Expectation-maximisation on it estimates how often each labeller votes bad for good and for bad
   documents, and the share of good ones. It starts from documents without a bad vote as good, and
   takes false alarms as rare beforehand (``FALSE_ALARMS``, with ``TRUST`` times the weight of the
   documents): a labeller sees one defect only, so most of them pass a bad document.
3. The posterior of a pattern labels a bounded sample (``SAMPLE_ROWS`` documents, none longer than
   ``SAMPLE_CHARS``), on which a logistic scorer over hashed features is fitted: n-grams of
   the character classes of the text, and how its words repeat.
4. The scorer (one weight per bucket, broadcast) reads every whole text; a document is accepted
   from a probability of one half on.

Defined results: a text without words (null, empty, white space) has score 0 and is rejected.
Repeated documents are judged each for itself. If the sample has no documents, or all its labels
agree, the score is the posterior of the document's own votes. ``score`` and ``accepted`` replace
columns of these names; other columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscore.llm.arrow import row_udf
from folioscore.llm.sample import bounded_sample

GOOD, BAD, ABSTAIN = "1", "0", "-"
BUCKETS = 1 << 11
FALSE_ALARMS, TRUST = 0.001, 10.0
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
LABELLERS = ("marks", "capitals", "same_as_last", "variety", "bars", "shouts", "sentences", "function_words")
#: Frequent function words of the languages that the labeller knows.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it was for on are as with he be at by this from "
    b"der die und in den von zu das mit sich des auf ist im dem nicht ein eine als "
    b"de la le et les des en un du une que est pour dans qui par sur au pas "
    b"el y los se del las con por su para una al lo como".split()
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARKS = b"#$%&*|<>{}[]=~^_\\@"
#: Class of each byte: space, small, capital, digit, beyond ASCII as small, each mark its own.
_CLASS = bytes(
    32 if c <= 32 else 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
    for c in range(256)
)
_PIECE = 1 << 22


def _vote(bad: bool, enough: bool = True) -> str:
    return ABSTAIN if not enough else BAD if bad else GOOD


def votes(text: str | None) -> str:
    """One vote per labeller, as a string."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return ABSTAIN * len(LABELLERS)
    size = len(data) - data.count(b" ") - data.count(b"\n")
    marks = len(data) - len(data.translate(None, _MARKS))
    capitals = len(data) - len(data.translate(None, _UPPER))
    letters = len(data) - len(data.translate(None, _LETTERS))
    same = sum(a == b for a, b in zip(words, words[1:]))
    stops = data.count(b".") + data.count(b"?") + data.count(b"!")
    lower = data.translate(_LOWER).split()
    function = sum(w in FUNCTION_WORDS for w in lower)
    variety = len(set(lower)) / n
    sentence = n / (stops + 1)
    return "".join(
        (
            _vote(marks >= 0.03 * max(size, 1)),
            _vote(capitals >= 0.5 * letters, letters > 0 and n >= 5),
            _vote(same >= 0.15 * n, n >= 10),
            _vote(variety < 0.25, n >= 40),
            _vote(data.count(b"|") >= 0.05 * n),
            _vote(data.count(b"!!") >= 0.05 * n),
            _vote(not 1.5 <= sentence <= 80, n >= 10),
            _vote(function < 0.01 * n, n >= 40),
        )
    )


@dataclass
class Accuracies:
    """Share of good documents; ``bad_votes[k, y]``: chance that labeller k votes bad on a document of
    class y (bad, good)."""

    good: float
    bad_votes: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability of good for each pattern; abstentions say nothing."""
        if not patterns:
            return np.empty(0)
        v = _coded(patterns)
        bad, passed = np.log(self.bad_votes), np.log(1 - self.bad_votes)
        odds = (v == 0) @ (bad[:, 1] - bad[:, 0]) + (v == 1) @ (passed[:, 1] - passed[:, 0])
        odds = odds + np.log(self.good) - np.log(1 - self.good)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def _coded(patterns: list[str]) -> np.ndarray:
    return np.array([[(BAD + GOOD + ABSTAIN).index(c) for c in p] for p in patterns])


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> Accuracies:
    """Expectation-maximisation over vote patterns and their counts."""
    v = _coded(patterns)
    good = np.where((v == 0).any(axis=1), 0.1, 0.9)
    trust = TRUST * (counts.sum() + 1)
    for _ in range(rounds):
        rates = []
        for weight, alarms, prior in (
            (counts * (1 - good), 0.5, 2.0),
            (counts * good, FALSE_ALARMS, trust),
        ):
            rates.append((weight @ (v == 0) + alarms * prior) / (weight @ (v != 2) + prior))
        share = float(np.clip((counts @ good + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        found = Accuracies(share, np.clip(np.array(rates).T, 1e-6, 1 - 1e-6))
        last, good = good, found.posterior(patterns)
        if np.abs(good - last).max() < 1e-6:
            break
    return found


def features(text: str | None) -> np.ndarray:
    """Hashed features of a text, square roots of shares; long texts are read in pieces."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(BUCKETS)
    for start in range(0, len(data), _PIECE):
        a = np.frombuffer(data[start : start + _PIECE].translate(_CLASS), np.uint8)
        a = a[np.concatenate([[True], a[1:] != a[:-1]])].astype(np.uint32)
        for n in (1, 2, 3, 4):
            m = len(a) - n + 1
            if m <= 0:
                break
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ a[k : k + m]) * np.uint32(0x01000193)
            out += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), minlength=BUCKETS)
    total = out.sum()
    out = np.sqrt(out / total) if total else out
    words = data.split()
    if words:
        same = sum(x == y for x, y in zip(words, words[1:])) / len(words)
        for name, value in ((1, same), (2, 1 - len(set(words)) / len(words))):
            out[(name * 0x9E3779B1 + min(int(value * 20), 19) * 0x85EBCA6B) % BUCKETS] += 1
    return out


def fit_scorer(rows: np.ndarray, good: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels."""
    weights, bias = np.zeros(rows.shape[1], rows.dtype), 0.0
    speed, speed_bias = np.zeros_like(weights), 0.0
    good = good.astype(rows.dtype)
    # both classes weigh alike
    weight = np.where(good > 0.5, 0.5 / max(good.sum(), 1), 0.5 / max((1 - good).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights + bias, -60, 60)))
        error = (p - good) * weight
        speed = 0.9 * speed + rows.T @ error + 1e-5 * weights
        speed_bias = 0.9 * speed_bias + error.sum()
        weights -= 2.0 * speed
        bias -= 2.0 * speed_bias
    return weights, float(bias)


@dataclass
class QualityModel:
    accuracies: Accuracies
    weights: np.ndarray | None
    bias: float

    def score(self, text: str | None) -> float:
        if not (text or "").split():
            return 0.0
        if self.weights is None:
            return float(self.accuracies.posterior([votes(text)])[0])
        z = features(text) @ self.weights + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_quality(docs: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Accuracies from all documents, scorer from a bounded sample."""
    vote = row_udf("string", lambda: votes)
    counted = docs.select(vote("text").alias("pattern")).groupBy("pattern").count().collect()
    patterns = [r["pattern"] for r in counted] or [ABSTAIN * len(LABELLERS)]
    counts = np.array([r["count"] for r in counted] or [0], float)
    accuracies = estimate(patterns, counts)
    sample = bounded_sample(
        docs.filter(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text"),
        int(counts.sum()), rows, "doc_id", "text",
    ).toArrow()
    texts = sample.column("text").to_pylist()
    good = accuracies.posterior([votes(t) for t in texts])
    if not len(good) or (good > 0.5).all() or (good <= 0.5).all():
        return QualityModel(accuracies, None, 0.0)
    weights, bias = fit_scorer(np.array([features(t) for t in texts], np.float32), good)
    return QualityModel(accuracies, weights, bias)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (probability of good) and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("score", row_udf("double", lambda: shared.value.score)("text")).withColumn(
        "accepted", F.col("score") >= threshold
    )
