"""The sequence kernels agree with the plain tables and with each other, and cost what they promise."""

import random
import time

import pytest

from folioscore.functions import sequences as sq
from tests.brute import edits, lcs

pytestmark = pytest.mark.unit


def changed(rng, text, n, letters="abcdefghij "):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice(letters))
        elif out and kind == 1:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def test_every_kernel_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randrange(25)))
        b = changed(rng, a, rng.randrange(6), "abc") if rng.random() < 0.6 else "".join(rng.choices("abc", k=rng.randrange(25)))
        want, common = edits(a, b), lcs(a, b)
        indel = len(a) + len(b) - 2 * common
        assert sq.edits_within(a, b, 60) == want and sq.indel_within(a, b, 60) == indel
        assert sq.lcs_by_matches(a, b) == common == sq.lcs_length(a, b)
        assert sq.edit_distance(a, b) == want
        if a and b:
            assert sq.lcs_by_vectors(a, b) == common and sq.edits_by_vectors(a, b) == want
        for most in range(8):  # a bound below the distance gives none
            assert sq.edits_within(a, b, most) == (want if want <= most else None)
            assert sq.indel_within(a, b, most) == (indel if indel <= most else None)


def test_chosen_kernels_agree_on_longer_texts():
    rng = random.Random(2)
    for n in (300, 1500):
        for k in (0, 3, 40, 400):
            a = "".join(rng.choices("abcdefghij ", k=n))
            b = changed(rng, a, k)
            x, y = (a, b) if len(a) >= len(b) else (b, a)
            assert sq.edit_distance(a, b) == sq.edits_by_vectors(x, y)
            assert sq.lcs_length(a, b) == sq.lcs_by_vectors(x, y)
            words, others = a.split(" "), b.split(" ")
            assert sq.lcs_length(words, others) == lcs(words, others) == sq.lcs_by_matches(words, others)


def test_near_equal_texts_of_a_million_characters():
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefghij ", k=1_000_000))
    b = changed(rng, a, 60)
    start = time.perf_counter()
    distance, common = sq.edit_distance(a, b), sq.lcs_length(a, b)
    assert time.perf_counter() - start < 15
    assert 0 < distance <= 60 and common >= 1_000_000 - 60


def test_long_lists_of_rare_words():
    rng = random.Random(4)
    a = [f"w{rng.randrange(10**7)}" for _ in range(40_000)]
    b = [x for x in a if rng.random() < 0.5] + [f"v{i}" for i in range(20_000)]
    rng.shuffle(b[:100])
    start = time.perf_counter()
    got = sq.lcs_length(a, b)
    quick = time.perf_counter() - start
    start = time.perf_counter()
    assert sq.lcs_by_vectors(a, b) == got
    assert quick < time.perf_counter() - start


def test_unlike_texts_go_to_the_bit_vectors(monkeypatch):
    rng = random.Random(5)
    a, b = ("".join(rng.choices("abcdefghij ", k=2000)) for _ in range(2))
    for name in ("edits_within", "indel_within"):
        monkeypatch.setattr(sq, name, lambda *_: pytest.fail("not alike"))
    assert sq.edit_distance(a, b) > 500 and sq.lcs_length(a, b) > 500
