"""Sequence kernels and the pandas UDFs over them.

Spark has no longest-common-subsequence function, and its ``levenshtein`` takes
time in the product of both lengths per pair. Three kernels give the same numbers at
different costs, and each pair takes the one that is cheapest for it:

* bit vectors (Hyyro's forms of LCS and edit distance) keep one row of the table in one integer, so
  a step over a character costs one pass over ``n/64`` machine words, however unlike the texts are;
* diagonals, for texts that share most of their parts: how far each diagonal is reached with ``d`` edits,
  for ``d`` = 0, 1, 2, …, so near-equal texts cost their length and the square of their distance. They
  are left for the bit vectors as soon as they have cost as much as those will;
* match lists and patience piles, for long lists of mostly rare words: the cost is the number of matches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_SMALL = 2048
#: Below this product of lengths the bit vectors are cheap enough not to look for another way.
_QUICK = 1 << 16
# Costs in microseconds: a step of the bit vectors and its share per 64 places, a diagonal, a match.
_STEP_US, _WORD_US, _DIAGONAL_US, _MATCH_US = 0.4, 0.009, 0.9, 0.25
_PROBES, _PROBE = 8, 12


def _shared_prefix(a, b) -> int:
    """Length of the common prefix by bisection over slice comparisons."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _core(a, b):
    """Both sequences without their common ends, and how much was cut."""
    head = _shared_prefix(a, b)
    a, b = a[head:], b[head:]
    tail = _shared_prefix(a[::-1], b[::-1])
    if tail:
        a, b = a[:-tail], b[:-tail]
    return a, b, head + tail


def _position_masks(a, wanted) -> dict:
    """For each symbol of ``wanted``: an integer with a bit per position in ``a``."""
    masks: dict = {}
    if len(a) <= _SMALL:
        bit = 1
        for x in a:
            masks[x] = masks.get(x, 0) | bit
            bit <<= 1
        return masks
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    for x in wanted:
        at = places.get(x)
        if at:
            bits = np.zeros(len(a), dtype=np.uint8)
            bits[at] = 1
            masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return masks


def _vector_cost(a, b) -> float:
    """Microseconds that the bit vectors take, ``b`` being the shorter."""
    return len(b) * (_STEP_US + len(a) / 64 * _WORD_US)


def _much_alike(a, b) -> bool:
    """Whether probes of the shorter sequence are mostly found in the longer one."""
    if isinstance(a, str):
        step = max(1, (len(b) - _PROBE) // _PROBES)
        probes = [b[i : i + _PROBE] for i in range(0, max(1, len(b) - _PROBE), step)]
        return 4 * sum(p in a for p in probes) >= 3 * len(probes)
    words = set(b)
    return 10 * len(words.intersection(a)) >= 9 * len(words)


def _most_edits(a, b) -> int:
    """The distance up to which diagonals cost no more than the bit vectors."""
    return int((_vector_cost(a, b) / _DIAGONAL_US) ** 0.5)


def _common(a, b, i: int, j: int) -> int:
    """Length of the common prefix of ``a[i:]`` and ``b[j:]``."""
    most = min(len(a) - i, len(b) - j)
    if most <= 0 or a[i] != b[j]:
        return 0
    done, size = 1, 8
    while done < most:
        end = min(done + size, most)
        if a[i + done : i + end] != b[j + done : j + end]:
            return done + _shared_prefix(a[i + done : i + end], b[j + done : j + end])
        done, size = end, size * 2
    return done


def indel_within(a, b, most: int) -> int | None:
    """Fewest insertions and deletions from ``a`` to ``b``, if at most ``most``: how
    much of ``a`` is reached on diagonal ``k`` = (place in a) - (place in b)."""
    n, m = len(a), len(b)
    goal = n - m
    if abs(goal) > most:
        return None
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            if abs(goal - k) > most - d:
                continue
            left, right = reach.get(k - 1, -1), reach.get(k + 1, -1)
            i = right if k == -d or (k != d and left < right) else left + 1
            if i < max(0, k) or i > n or i - k > m:
                continue
            i += _common(a, b, i, i - k)
            if k == goal and i >= n:
                return d
            reach[k] = i
    return None


def edits_within(a, b, most: int) -> int | None:
    """Unit-cost edit distance, if at most ``most``, over diagonals."""
    n, m = len(a), len(b)
    goal = n - m
    if abs(goal) > most:
        return None
    reach: dict[int, int] = {}
    for d in range(most + 1):
        new: dict[int, int] = {}
        for k in range(-d, d + 1):
            if abs(goal - k) > most - d:
                continue
            if d:
                i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            else:
                i = 0
            if i < 0:
                continue
            i = min(i, n, m + k)
            if i < 0 or i - k < 0:
                continue
            i += _common(a, b, i, i - k)
            if k == goal and i >= n:
                return d
            new[k] = i
        reach = new
    return None


def _few_matches(a, b, most_us: float) -> bool:
    """Whether equal places of two lists are so few that match lists cost less than ``most_us``."""
    in_b = Counter(b)
    return _MATCH_US * (sum(n * in_b[x] for x, n in Counter(a).items()) + len(a)) < most_us


def lcs_by_matches(a, b) -> int:
    """LCS length from match lists: ``ends[k]`` is the least end in ``b`` of a common subsequence of k + 1."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    for x in a:
        for j in reversed(places.get(x, ())):  # from the right, so that one x is matched once
            k = bisect_left(ends, j)
            if k == len(ends):
                ends.append(j)
            else:
                ends[k] = j
    return len(ends)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two strings or lists."""
    a, b, cut = _core(a, b)
    if not a or not b:
        return cut
    if len(a) < len(b):
        a, b = b, a
    if len(a) * len(b) > _QUICK:
        if _much_alike(a, b):
            edits = indel_within(a, b, _most_edits(a, b))
            if edits is not None:
                return cut + (len(a) + len(b) - edits) // 2
        if not isinstance(a, str) and _few_matches(a, b, _vector_cost(a, b)):
            return cut + lcs_by_matches(a, b)
    return cut + lcs_by_vectors(a, b)


def lcs_by_vectors(a, b) -> int:
    """LCS length by bit vectors over the positions of ``a``."""
    masks = _position_masks(a, set(b))
    full = (1 << len(a)) - 1
    row = full
    hits = filter(None, map(masks.get, b))
    if len(a) <= _SMALL:
        # carries beyond the last position are cut off once, at the end
        for hit in hits:
            u = row & hit
            row = (row + u) | (row ^ u)
    else:
        for hit in hits:
            u = row & hit
            row = ((row + u) | (row ^ u)) & full
    return len(a) - (row & full).bit_count()


def lcs_items(a, b) -> set:
    """Items on one longest common subsequence, traced from the ends: a match is
    taken, else ``a`` is shortened where that alone keeps the length, else ``b``."""
    masks = _position_masks(b, set(a))
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        row = rows[-1]
        u = row & masks.get(x, 0)
        rows.append(((row + u) | (row - u)) & full)
    items = set()
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            items.add(a[i - 1])
            i, j = i - 1, j - 1
        elif (rows[i] >> (j - 1)) & 1:
            j -= 1
        else:
            i -= 1
    return items


def union_lcs(evaluated, reference) -> int:
    """Number of distinct words on the common subsequences of all sentence pairs."""
    found: set = set()
    for x in reference:
        words = set(x)
        for y in evaluated:
            if not words.isdisjoint(y):
                found |= lcs_items(x, y)
    return len(found)


def edit_distance(a, b) -> int:
    """Unit-cost edit distance of two strings or lists."""
    a, b, _ = _core(a, b)
    if not a or not b:
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    if len(a) * len(b) > _QUICK and _much_alike(a, b):
        edits = edits_within(a, b, _most_edits(a, b))
        if edits is not None:
            return edits
    return edits_by_vectors(a, b)


def edits_by_vectors(a, b) -> int:
    """Edit distance by bit vectors over the positions of ``a``."""
    masks = _position_masks(a, set(b))
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = masks.get(x, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        low = plus & across
        if up & top:
            score += 1
        elif low & top:
            score -= 1
        up = ((up << 1) | 1) & full
        low = (low << 1) & full
        plus = low | (full & ~(down | up))
        minus = up & down
    return score


def _over(kernel, prepare=lambda x: x):
    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if a is None or b is None else kernel(prepare(a), prepare(b))
                for a, b in zip(left, right)
            ],
            dtype="Int64",
        )

    apply.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return apply


_lcs_chars = F.pandas_udf(_over(lcs_length), LongType())
_lcs_words = F.pandas_udf(_over(lcs_length, lambda s: s.split(" ") if s else []), LongType())
_lcs_union = F.pandas_udf(
    _over(union_lcs, lambda s: [t.split(" ") for t in s.split(".") if t]), LongType()
)
_edits = F.pandas_udf(_over(edit_distance), LongType())


def _unequal(udf, a: Column, b: Column) -> Column:
    """Call ``udf`` on differing texts only; equal ones are sent as nulls."""
    differ = a != b
    return udf(F.when(differ, a), F.when(differ, b))


def lcs_chars(a: Column, b: Column) -> Column:
    """LCS length over code points; null where the texts are equal."""
    return _unequal(_lcs_chars, a, b)


def lcs_words(a: Column, b: Column) -> Column:
    """LCS length over words of ``rouge_text`` columns; null where equal."""
    return _unequal(_lcs_words, a, b)


def lcs_sentences(a: Column, b: Column) -> Column:
    """Distinct common-subsequence words of ``rouge_sentences`` columns; null
    where equal."""
    return _unequal(_lcs_union, a, b)


def levenshtein_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance over code points of whole texts."""
    return F.coalesce(_unequal(_edits, a, b), F.lit(0).cast("long"))
