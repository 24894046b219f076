"""Periodic runs of words within a text, by seeds on diagonals that are extended.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 q)`` words that no
neighbouring word extends. Its words ``q`` apart are equal, so on the diagonal of lag ``q`` it is a
stretch of at least ``max(6 - q, 3 q)`` matches. Lags are taken in classes ``P <= q < 2 P`` with
``P`` = 1, 2, 4, ...; ``k = max(6 - P, 3 P)`` matches are the least overlap that every run of the class
has, and the k-grams of the text are the class's index.

* *Seeds.* In a run, a k-gram meets its next occurrence exactly ``q`` words later: ``k >= q``, so an
  earlier one would give the run a smaller period (Fine and Wilf). Neighbouring occurrences of a
  k-gram are therefore all the pairs that are needed, at most one per word and class, and a pair from
  a stretch that is long enough has the smallest period as its lag. A word that is repeated all over
  a text costs no more than any other.
* *Index.* k-grams get exact names: equal words have equal numbers, and names of ``2 k`` words are
  made of two names of ``k`` words. A gram that occurs once is left out for good, since every longer
  gram that holds it occurs once too, so higher classes work on repeated places only.
* *Extension.* Seeds of a lag that touch are one; it is extended in both directions while words ``q``
  apart are equal. A table holds, per lag, how far matches have been covered, and a seed inside
  what is covered is not extended again.

The texts of a piece are worked on at once: a word's number is the place where its text first has
it, so no gram occurs in two texts. Words are ``[^\\x20\\x09-\\x0D]+``, compared as bytes.

Defined results: a null text, an empty one and one without runs have an empty array of runs; the
collapsed text of a null text is empty. ``collapsed`` joins the kept words by one space; a word goes if
any run has it after its first ``q`` words. Every row is worked on for itself, repeated rows too; other columns
are passed on, and a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscore.llm.arrow import text_udf
from folioscore.llm.names import unused

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_STEP = 64


def word_numbers(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Words of every text, the numbers of all words, and where each text ends among them."""
    words = [t.split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    numbers = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    at = 0
    for w in words:
        first: dict = {}
        numbers[at : at + len(w)] = np.fromiter(map(first.setdefault, w, count(at)), np.int64, len(w))
        at += len(w)
    return words, numbers, ends


def _named(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of pairs, and which pairs occur more than once."""
    base = int(right.max()) + 1 if len(right) else 1
    _, name, times = np.unique(left * base + right, return_inverse=True, return_counts=True)
    return name, times[name] > 1


def _repeated_places(numbers: np.ndarray, k: int) -> np.ndarray:
    """Places whose k-gram may occur again: all that do, and few others."""
    n = len(numbers) - k + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h + numbers[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bits = max(8, (4 * n).bit_length())
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)


def _stretch(numbers: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or back (-1) equal the word ``lag`` after."""
    done, size = 0, _STEP
    while True:
        if step > 0:
            lo, hi = at + done, min(at + done + size, len(numbers) - lag)
        else:
            lo, hi = max(at - done - size + 1, 0), at - done + 1
        if hi <= lo:
            return done
        unequal = np.flatnonzero(numbers[lo:hi] != numbers[lo + lag : hi + lag])
        if len(unequal):
            return done + int(unequal[0] if step > 0 else hi - lo - 1 - unequal[-1])
        done, size = done + hi - lo, size * 2


def periodic_runs(numbers: np.ndarray) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start, then period."""
    found = []
    places = _repeated_places(numbers, 5)
    name = numbers[places]
    for j in range(1, 5):  # exact names of the 5-grams
        if not len(places):
            break
        name, again = _named(name, numbers[places + j])
    if len(places):
        places, name = places[again], name[again]
    k, least = 5, 1
    names = np.full(len(numbers), -1, np.int64)
    while len(places):
        found += _class_runs(numbers, places, name, k, least)
        # the next class: one word more after the 5-grams, names of twice the length from then on
        more = 1 if k == 5 else k
        if k == 5:
            following = numbers
        else:
            following = names
            following[:] = -1
            following[places] = name
        inside = places + k < len(numbers)
        places, name = places[inside], name[inside]
        tail = following[places + k]
        there = tail >= 0
        places, name, tail = places[there], name[there], tail[there]
        if len(places):
            name, again = _named(name, tail)
            places, name = places[again], name[again]
        k, least = k + more, least * 2
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _class_runs(numbers: np.ndarray, places: np.ndarray, name: np.ndarray, k: int, least: int) -> list:
    """Runs of periods ``least`` to ``2 least - 1``, from neighbouring occurrences of k-grams."""
    order = np.lexsort((places, name))
    p, q = places[order], name[order]
    lag = np.where(q[1:] == q[:-1], p[1:] - p[:-1], 0)
    seeds = (lag >= least) & (lag < 2 * least)
    p, lag = p[:-1][seeds], lag[seeds]
    order = np.lexsort((p, lag))
    p, lag = p[order], lag[order]
    if not len(p):
        return []
    opens = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (p[1:] > p[:-1] + k)]))
    closes = np.append(opens[1:], len(p)) - 1
    covered: dict[int, int] = {}
    runs = []
    for first, last, d in zip(p[opens].tolist(), p[closes].tolist(), lag[opens].tolist()):
        if first < covered.get(d, 0):
            continue
        start = first - _stretch(numbers, first - 1, d, -1)
        end = last + k + _stretch(numbers, last + k, d, 1)
        covered[d] = end
        if end + d - start >= max(6, 4 * d):
            runs.append((start, end + d - start, d))
    return runs


def _work():
    def work(texts: list) -> pa.Array:
        words, numbers, ends = word_numbers(texts)
        runs = periodic_runs(numbers)
        owner = np.searchsorted(ends, runs[:, 0], "right")
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        runs[:, 0] -= begins[owner]
        per_text = np.bincount(owner, minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
        collapsed = []
        for i, w in enumerate(words):
            if per_text[i]:
                keep = np.zeros(len(w) + 1, np.int64)
                mine = runs[offsets[i] : offsets[i + 1]]
                np.add.at(keep, mine[:, 0] + mine[:, 2], 1)
                np.add.at(keep, mine[:, 0] + mine[:, 1], -1)
                w = [w[j] for j in np.flatnonzero(np.cumsum(keep)[:-1] == 0)]
            collapsed.append(b" ".join(w))
        names = ["start", "length", "period"]
        found = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in range(3)], names)
        return pa.StructArray.from_arrays(
            [
                pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), found),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            ["n_words", "runs", "collapsed"],
        )

    return work


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``."""
    found = text_udf(RESULT, _work)(F.coalesce(F.col(text).cast("string"), F.lit("")))
    given = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    name = unused(docs, "found")
    return docs.select(*given, found.alias(name)).select(*given, f"`{name}`.*")
