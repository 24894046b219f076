"""Packing: the reduction never costs a sequence, best fit equals a plain version, ids come back whole."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscore.llm import packing
from folioscore.llm.queries import op12_pack_documents


def fewest(items, capacity):
    """Fewest sequences by trying every place for every piece."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for b in {r: b for b, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[b] -= items[i]
            place(i + 1, rooms)
            rooms[b] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def plain_best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def held(groups):
    total = Counter()
    for n, pieces in groups:
        for size, times in pieces:
            total[size] += n * times
    return total


@pytest.mark.unit
def test_reduction_keeps_the_optimum():
    rng, fixed = random.Random(1), 0
    for _ in range(1500):
        capacity, low = rng.choice([10, 13, 20, 31]), rng.choice([1, 1, 2, 4, 6])
        items = [rng.randrange(low, capacity + 1) for _ in range(rng.randrange(10))]
        groups, left = packing.reduce_pieces(Counter(items), capacity)
        assert held(groups) + Counter(left) == Counter(items)
        assert all(sum(s * t for s, t in g) <= capacity for _, g in groups)
        done = sum(n for n, _ in groups)
        assert fewest(items, capacity) == done + fewest(list(Counter(left).elements()), capacity)
        fixed += done
    assert fixed > 3000


@pytest.mark.unit
def test_best_fit_equals_plain():
    rng = random.Random(2)
    for _ in range(500):
        items = [rng.randrange(1, 32) for _ in range(rng.randrange(80))]
        groups = packing.best_fit(Counter(items), 31)
        rooms = sorted(31 - sum(s * t for s, t in g) for n, g in groups for _ in range(n))
        assert rooms == plain_best_fit(items, 31) and held(groups) == Counter(items)


@pytest.mark.unit
def test_plan_is_near_the_bound_and_small():
    rng = random.Random(3)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(200_000))
    many = {s: n * 10_000 for s, n in counts.items()}
    for given in (counts, many):
        plan = packing.packing_plan(given)
        sequences = int(plan[:, 4].max()) + 1
        bound = -(-sum(s * n for s, n in given.items()) // 2048)
        assert bound <= sequences <= bound * 1.001 + 2
        assert len(plan) < 20_000
    assert packing.packing_plan({}).shape == (0, 5)


def check_packing(rows, ids_of, capacity):
    """Pieces are whole documents or cuts of longer ones; sequences have no gap and no overlap."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for doc, pieces in docs.items():
        want = ids_of[doc]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(want) // capacity)))
        assert [r["start"] for r in pieces] == list(range(0, len(want), capacity))
        assert [i for r in pieces for i in np.frombuffer(r["ids"], "<u4")] == want
    return len(sequences)


def texts(rng):
    words = ["Ünïcode", "naïve", "word", "日本語", "42", "don't", "É", "<|endoftext|x", "áb"]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(40)))) for i in range(200)]
    return [*rows, (300, None), (301, ""), (302, " \n"), (303, "hot"), (304, "hot"), (None, "no id"), (305, "w " * 500)]


@pytest.mark.unit
@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_ids_and_places(spark, broadcast_rows):
    rows = texts(random.Random(4))
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, offset string, _task int").repartition(5)
    got = packing.pack_documents(df, capacity=64, broadcast_rows=broadcast_rows)
    assert set(got.columns) == {"doc_id", "_task", *packing.ADDED}
    got = got.collect()
    assert all(r["_task"] == 7 for r in got)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    used = check_packing(got, ids, 64)
    bound = -(-sum(map(len, ids.values())) // 64)
    assert used <= bound + 2
    assert packing.pack_documents(df.limit(0)).collect() == []


@pytest.mark.unit
def test_words_have_the_ids_of_the_text():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    memo, cut = packing._tokenizer(None)
    rng = random.Random(6)
    parts = [*"abcé́Σ.1'", " ", "\n", "\x0b", "\u00a0", "\u180e", "가", "ᆨ", "<|endoftext|>", "日本", "ABC", "'S", "İ", "ſ"]
    text = "".join(rng.choices(parts, k=5000))
    for given in (text, text + " <|ENDOFTEXT|>"):
        words = cut(given.encode())
        ((ids, _),) = memo.look_up(words)
        assert len(words) > 500 and ids.tolist() == t.encode(given, add_special_tokens=False).ids


@pytest.mark.integration
def test_query(spark, tmp_path):
    rows = [r for r in texts(random.Random(5)) if r[0] is not None]
    rows.append((400, "very long " * 3000))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_pack_documents(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            piece = ids[start : start + 2048]
            want.add((i, n, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
