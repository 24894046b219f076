"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A text is lower-cased and cut in words; digits and signs that stand for letters become those
letters. A word, with a mark at both ends, is the bag of its n-grams of 3 to 6 characters, each
hashed to one of ``BUCKETS`` vectors. A word is the mean of its n-grams' vectors and a text the mean of its
words, so a text is toxic by the dose of its words, however long it is; a misspelt or inflected word
shares most n-grams, and so most of its vector, with one that was learnt. The mean goes through a linear
softmax of two classes.

Labels are of texts, and so is the training: accelerated gradient descent on the cross-entropy of all sampled
texts, both classes of equal weight, over vectors, softmax and bias together. Vectors start at zero. An n-gram's
part in a mean is measured against how common it is (to the power ``COMMON``), and a penalty on the length of
each vector keeps those at zero that the labels do not ask for: a few hundred of a million stay.

The model is fitted on the driver on a bounded sample: at most ``SAMPLE_ROWS`` labelled texts, drawn
by a hash of the id, none longer than ``SAMPLE_CHARS``. Scoring needs one number per bucket, which is
broadcast (4 MB), and reads whole texts; a worker keeps the worth of words that come again.

Defined results: a null text is an empty one; a text without words has the probability of the bias
alone. Without both labels in the sample all scores are 0. Repeated ids are scored row by row.
``score`` replaces a column of that name; other columns pass unchanged.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscore.llm.arrow import text_udf
from folioscore.llm.sample import bounded_sample
from folioscore.llm.texthash import mix

BUCKETS = 1 << 20
DIM = 4
LENGTHS = (3, 4, 5, 6)
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
EPOCHS = 150
#: Texts of the sample that an n-gram has to stand in to have a vector.
LEAST_TEXTS = 5
COMMON = 0.55
#: The penalty as a share of the one that would keep all vectors at zero.
PENALTY = 0.03
#: Words whose worth a worker keeps.
HELD_WORDS = 300_000
#: Epochs from one step of the softmax to the next; the vectors take one in each.
_TURN = 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MARKS = str.maketrans(
    {c: " " for c in "\t\n\v\f\r.,;:!?\"()[]{}<>|/\\«»“”…#%&*=+~^_"}
    | dict(zip("013457@$", "oieastas"))
)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words."""
    return [w for w in (text or "").lower().translate(_MARKS).split(" ") if w]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram of words.

    An n-gram may begin or end with the mark before or after its word, and has none inside.
    """
    data = " " + " ".join(words) + " "
    wide = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blanks = np.concatenate([[0], np.cumsum(wide == 32)])
    ids, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in LENGTHS:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * _ODD + wide[k : k + m]
        at = np.flatnonzero(blanks[n - 1 : n - 1 + m] == blanks[1 : 1 + m])
        ids.append((mix(h[at]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        places.append(blanks[at + 1] - 1)
    return np.concatenate(ids), np.concatenate(places)


def word_worths(words: list[str], worth: np.ndarray) -> np.ndarray:
    """Mean worth of the n-grams of each word; 0 for a word too short to have any."""
    ids, places = ngrams(words)
    sums = np.bincount(places, worth[ids], minlength=len(words))
    return sums / np.maximum(np.bincount(places, minlength=len(words)), 1)


def probability(text: str | None, worth: np.ndarray, bias: float) -> float:
    words = words_of(text)
    z = (word_worths(words, worth).mean() if words else 0.0) + bias
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Means:
    """The bags of a sample as a sparse table: a row per text, a column per n-gram of enough texts."""

    def __init__(self, texts: list[list[str]], least_texts: int):
        buckets, values, sizes = [], [], []
        for words in texts:
            ids, places = ngrams(words)
            each = 1 / (np.bincount(places, minlength=max(len(words), 1))[places] * max(len(words), 1))
            bucket, at = np.unique(ids, return_inverse=True)
            buckets.append(bucket.astype(np.int32))
            values.append(np.bincount(at, each, minlength=len(bucket)).astype(np.float32))
            sizes.append(len(bucket))
        often = np.zeros(BUCKETS, np.int32)
        for bucket in buckets:
            often[bucket] += 1
        wanted = often >= min(least_texts, len(texts))
        for i, bucket in enumerate(buckets):
            kept = wanted[bucket]
            buckets[i], values[i], sizes[i] = bucket[kept], values[i][kept], int(kept.sum())
        self.buckets = np.flatnonzero(wanted & (often > 0))
        place = np.zeros(BUCKETS, np.int32)
        place[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        self.column, self.value = place[np.concatenate(buckets)], np.concatenate(values)
        del buckets, values
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        common = np.bincount(self.column, self.value, len(self.buckets)) / len(texts)
        self.scale = 1 / (common + 1e-6) ** COMMON
        self.value *= self.scale.astype(np.float32)[self.column]
        order = np.argsort(self.column, kind="stable").astype(np.int32)
        self.row_by_column, self.value_by_column = self.row[order], self.value[order]
        self.row_ends = np.concatenate([[0], np.cumsum(sizes)])
        self.column_ends = np.concatenate([[0], np.cumsum(np.bincount(self.column, minlength=len(self.buckets)))])
        del order, self.row

    def of_texts(self, by_column: np.ndarray) -> np.ndarray:
        """Means of a number per n-gram over each text."""
        return _sums(by_column.astype(np.float32)[self.column], self.value, self.row_ends)

    def of_ngrams(self, by_text: np.ndarray) -> np.ndarray:
        """Sums of a number per text over each n-gram."""
        return _sums(by_text.astype(np.float32)[self.row_by_column], self.value_by_column, self.column_ends)


def _sums(values: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weighted sums between ends; ``values`` are used up."""
    values *= weights
    out = np.zeros(len(ends) - 1)
    some = np.diff(ends) > 0
    if some.any():
        out[some] = np.add.reduceat(values, ends[:-1][some])
    return out


class SubwordModel:
    """Vectors of n-grams and the softmax over their means, learnt together."""

    def __init__(self, columns: int, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.vectors = np.zeros((dim, columns))
        self.weights = rng.normal(size=(dim, 2))
        self.bias = np.zeros(2)
        self._unit()

    def _unit(self) -> None:
        """The softmax turns the vectors and leaves their length to the penalty."""
        self.weights /= np.linalg.norm(self.weights[:, 1] - self.weights[:, 0])

    def worth(self) -> np.ndarray:
        """What each n-gram adds to the log odds of label 1."""
        return (self.weights[:, 1] - self.weights[:, 0]) @ self.vectors

    def learn(self, means: Means, labels: np.ndarray, shares: np.ndarray, epochs: int, penalty: float) -> None:
        """Accelerated proximal gradient descent; ``shares`` are the weights of the texts, 1 in all."""
        rate = 1 / (0.5 * _steepest(means, shares))
        wanted = np.eye(2)[labels]
        least = None
        vectors, bias, t = self.vectors, self.bias, 1.0
        ahead, ahead_bias = vectors, bias
        for epoch in range(epochs):
            z = np.outer(means.of_texts((self.weights[:, 1] - self.weights[:, 0]) @ ahead), [-0.5, 0.5]) + ahead_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = shares[:, None] * (p - wanted)
            slope = means.of_ngrams(error[:, 1] - error[:, 0]) / 2
            if least is None:  # the penalty under which every vector would stay at zero
                least = penalty * np.abs(slope).max()
            new = ahead - rate * np.outer(self.weights[:, 1] - self.weights[:, 0], slope)
            length = np.sqrt(np.einsum("ij,ij->j", new, new))
            new *= np.maximum(0, 1 - rate * least / np.maximum(length, 1e-12))
            new_bias = ahead_bias - rate * error.sum(axis=0)
            if epoch % _TURN == 0:
                hidden = np.stack([means.of_texts(v) for v in new])
                self.weights -= 0.1 * rate * (hidden @ error) / max(1.0, np.abs(hidden).max())
                self._unit()
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            ahead = new + (before - 1) / t * (new - vectors)
            ahead_bias = new_bias + (before - 1) / t * (new_bias - bias)
            vectors, bias = new, new_bias
        self.vectors, self.bias = vectors, bias


def _steepest(means: Means, shares: np.ndarray, steps: int = 20) -> float:
    """Largest curvature of the loss in the vectors, by power iteration."""
    v = np.ones(len(means.buckets)) / max(len(means.buckets), 1) ** 0.5
    size = 1.0
    for _ in range(steps):
        v = means.of_ngrams(shares * means.of_texts(v))
        size = float(np.linalg.norm(v))
        if size == 0:
            return 1.0
        v /= size
    return max(size, shares.sum())


def train(
    texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1, penalty: float = PENALTY
) -> tuple[np.ndarray, float]:
    """Worth of each bucket and the bias of the log odds, from labelled texts."""
    labels = np.asarray(labels)
    words = [words_of(t) for t in texts]
    if len(set(labels.tolist())) < 2 or not any(words):
        return np.zeros(BUCKETS, np.float32), -60.0
    # copies of one text count as one, and both labels count alike
    keys = [" ".join(w) for w in words]
    copies = Counter(keys)
    shares = np.array([1 / copies[k] for k in keys])
    shares /= 2 * np.bincount(labels, shares)[labels]
    means = Means(words, LEAST_TEXTS)
    model = SubwordModel(len(means.buckets), DIM, seed)
    model.learn(means, labels, shares, epochs, penalty)
    worth = np.zeros(BUCKETS, np.float32)
    worth[means.buckets] = model.worth() * means.scale
    return worth, float(model.bias[1] - model.bias[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnt: Column, rows: int = SAMPLE_ROWS):
    """Model from the labelled documents for whose ``doc_id`` the condition ``learnt`` holds.

    ``labels`` has ``doc_id, toxic``; labels of one id that differ count as toxic. The ids are drawn
    first, so no text is shuffled but those of the sample.
    """
    known = labels.filter(F.col("toxic").isNotNull() & learnt).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = bounded_sample(known, known.count(), rows, "doc_id")
    sample = (
        docs.filter(F.length("text") <= SAMPLE_CHARS)
        .select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")  # at most ``rows`` rows
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(rows)
        .toArrow()
    )
    return train(sample.column("text").to_pylist(), sample.column("toxic").to_numpy())


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        worth, bias = shared.value
        held: dict[str, float] = {}

        def work(texts: list) -> pa.Array:
            nonlocal held
            words = [words_of(t.decode() if t else "") for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            flat = [w for own in words for w in own]
            values = np.fromiter(map(held.get, flat, repeat(np.nan)), np.float64, len(flat))
            missing = np.flatnonzero(np.isnan(values)).tolist()
            new = list(dict.fromkeys(map(flat.__getitem__, missing)))
            if new:
                held.update(zip(new, word_worths(new, worth).tolist()))
                values[missing] = [held[flat[i]] for i in missing]
            if len(held) > HELD_WORDS:  # words that came first are the frequent ones
                held = dict(islice(held.items(), HELD_WORDS // 2))
            of = np.repeat(np.arange(len(words)), sizes)
            z = np.bincount(of, values, minlength=len(words)) / np.maximum(sizes, 1) + bias
            return pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return work

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("score", text_udf("double", make, most_bytes=1 << 20)(text))
