"""Documents packed into sequences of bounded length: dominance reduction, then best fit.

A document is its token ids and an end id. One that is longer than a sequence is cut into pieces as
long as a sequence, the last one shorter; no other is cut. What is to be packed is then the number of
pieces of every length, at most ``CAPACITY`` numbers however many documents there are.

* *Reduction* (Martello and Toth). For a piece ``j``, a set of pieces that shares a sequence with it
  dominates all others if in any packing what else lies with ``j`` can change places with it. Such a
  set is fixed for good and taken out; this never costs a sequence. Proven here: the piece that fills the
  sequence exactly; ``j`` alone where nothing fits; the longest that fits where no two others fit; and
  where no three others fit, the longest one if no two are longer together, or the longest one with the
  longest that fits beside it if no pair has a longer second. Passes go on until nothing more is fixed.
* *Best fit.* The rest goes, longest first, to the sequence in which it leaves the least room.
  Equal lengths are dealt to equal sequences at once, so the work depends on the lengths that occur
  and not on how many pieces have them.

Both steps work on counts and give groups of equal sequences, at most two for every length and step;
each group takes a stretch of the pieces of a length, in the order of their numbers. A piece's number among those of its
length is its place in its task and what earlier tasks have. Texts and ids never move for the packing.

Tokens are made once and written to the shared folder as little-endian unsigned 32-bit ids. The default
tokenizer drops white space and joins nothing over it, so a worker keeps the ids of words that come
again; with a tokenizer for which this does not hold, whole texts are encoded.

Defined results: a null text is empty, an empty one is the end id alone. Repeated rows are packed
each for itself. An empty table gives no rows. Columns ``piece, start, length, ids, sequence_id,
offset`` are added; given columns of these names and the text are left out.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscore.llm.arrow import map_texts
from folioscore.llm.names import unused
from folioscore.llm.wordmemo import JoinedWords, WordMemo, per_text
from folioscore.session import workspace

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps.
HELD_WORDS = 1_000_000
#: Rows of counts by task and length that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
ADDED = ("piece", "start", "length", "ids", "sequence_id", "offset")

Group = tuple[int, list[tuple[int, int]]]  # equal sequences, (length, pieces of it in each)


def _fix(counts: dict[int, int], sizes: list[int], capacity: int, groups: list[Group]) -> bool:
    """One pass of the reduction over all lengths, longest first; whether anything was fixed."""
    fixed = False

    def rest(j: int, k: int) -> int:
        return counts[k] - (k == j)

    def least(j: int, n: int) -> int | None:
        """Sum of the ``n`` shortest other pieces; none where there are fewer."""
        total = 0
        for k in sizes:
            take = min(n, rest(j, k))
            total, n = total + take * k, n - take
            if not n:
                return total
        return None

    def longest(j: int, room: int, without: int | None = None) -> int | None:
        return next((k for k in reversed(sizes) if k <= room and rest(j, k) - (k == without) > 0), None)

    def pairs(j: int, room: int) -> tuple[int, int]:
        """Of the pairs that fit in ``room``: the greatest sum, and the greatest shorter piece."""
        there = [k for k in sizes if k <= room and rest(j, k)]
        together = second = 0
        lo, hi = 0, len(there) - 1
        while lo <= hi:
            if there[lo] + there[hi] > room or (lo == hi and rest(j, there[lo]) < 2):
                hi -= 1
                continue
            together = max(together, there[lo] + there[hi])
            lo += 1
        for i, k in enumerate(there):
            longer = k if rest(j, k) > 1 else there[i + 1] if i + 1 < len(there) else room
            if k + longer <= room:
                second = k
        return together, second

    for j in list(reversed(sizes)):
        while counts[j]:
            room = capacity - j
            k = longest(j, room)
            if k is None:
                chosen = [j]
            elif k == room or (two := least(j, 2)) is None or two > room:
                chosen = [j, k]
            elif (three := least(j, 3)) is None or three > room:
                together, second = pairs(j, room)
                beside = longest(j, room - k, k)
                if together <= k:
                    chosen = [j, k]
                elif beside is not None and second <= beside:
                    chosen = [j, k, beside]
                else:
                    break
            else:
                break
            need = {s: chosen.count(s) for s in chosen}
            times = min(counts[s] // n for s, n in need.items())
            groups.append((times, sorted(need.items(), reverse=True)))
            for s, n in need.items():
                counts[s] -= times * n
            fixed = True
        sizes[:] = [s for s in sizes if counts[s]]
    return fixed


def reduce_pieces(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Groups that some best packing holds, and the counts of the pieces that are left."""
    counts = {s: n for s, n in counts.items() if n}
    groups: list[Group] = []
    while counts and _fix(counts, sorted(counts), capacity, groups):
        counts = {s: n for s, n in counts.items() if n}
    return groups, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Longest pieces first, each to the open sequence with the least room that it fits in."""
    rooms: dict[int, list] = {}  # room left -> groups (sequences, pieces so far)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in rooms if r >= size), default=capacity)
            sequences, held = rooms[room].pop() if room in rooms else (left, [])
            if not rooms.get(room, True):
                del rooms[room]
            # a sequence that has taken one has the least room, so it takes the next, while it can
            most = room // size
            whole = min(sequences, left // most)
            part = left - whole * most if whole < sequences else 0
            if whole:
                rooms.setdefault(room - most * size, []).append((whole, [*held, (size, most)]))
            if part:
                rooms.setdefault(room - part * size, []).append((1, [*held, (size, part)]))
            untouched = sequences - whole - bool(part)
            if untouched and held:
                rooms.setdefault(room, []).append((untouched, held))
            left -= whole * most + part
    return [g for groups in rooms.values() for g in groups]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, first number, pieces a sequence, offset, first sequence``, by length and number."""
    fixed, left = reduce_pieces(counts, capacity)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for sequences, held in fixed + best_fit(left, capacity):
        offset = 0
        for size, times in held:
            rows.append((size, used[size], times, offset, sequence))
            used[size] += sequences * times
            offset += size * times
        sequence += sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


@lru_cache(maxsize=2)
def _tokenizer(path: str | None) -> tuple[WordMemo, Callable[[bytes], list]]:
    """The words' ids, held by the worker, and the function that cuts a text into words.

    Words are whole texts where the tokenizer does not take them apart at white space; A-Z are lower-cased
    where it does so itself, unless that would make a special token.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    words = JoinedWords(Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER)))

    def same(trial: str, parts: list[str]) -> bool:
        whole = words.each([trial])[0].tolist()
        return all(f(parts)[0].tolist() == whole for f in (words, words.each))

    trial = "a\tb\nc\x0bd\x0ce\rf  g"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ Cat'S A1B"
    apart, lowers = same(trial, trial.split()), same(alphabet, [alphabet.lower()])

    def cut(text: bytes) -> list:
        if lowers:
            lower = text.lower()
            if all(lower.count(s) == text.count(s) for s in words.special):
                text = lower
        return text.split() if apart else [text]

    return WordMemo(lambda new: (words([w.decode() for w in new]),), most=HELD_WORDS), cut


def _pieces(names: list[str], path: str | None, capacity: int, end_id: int):
    """Function of the texts of a task: their pieces, numbered by length within the task."""
    memo, cut = _tokenizer(path)
    places = np.zeros(capacity + 1, np.int64)
    context = TaskContext.get()
    task = context.partitionId() if context else 0

    def work(texts: pa.Array, rest: pa.RecordBatch) -> pa.RecordBatch:
        words = [cut(t) if t else [] for t in texts.to_pylist()]
        n_words = np.array([len(w) for w in words], np.int64)
        ((ids, sizes),) = memo.look_up([w for own in words for w in own])
        n_ids = per_text(sizes, n_words)
        # the end id after the ids of every text
        ids = np.insert(ids.astype("<u4"), np.cumsum(n_ids), end_id)
        n_ids = n_ids + 1
        text_start = np.cumsum(n_ids) - n_ids
        n_pieces = -(-n_ids // capacity)
        owner = np.repeat(np.arange(len(texts)), n_pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = piece * capacity
        length = np.minimum(n_ids[owner] - start, capacity)
        # a piece's number among those of its length: earlier calls of the task, then this one
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(first, len(ordered)))
        place = np.empty(len(length), np.int64)
        place[order] = np.arange(len(ordered)) - np.repeat(first, times) + places[ordered]
        places[ordered[first]] += times
        ends = np.append(text_start[owner] + start, len(ids)) * 4
        held = pa.BinaryArray.from_buffers(
            pa.binary(), len(owner), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)]
        )
        columns = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), held]
        columns += [pa.array(np.full(len(owner), task, np.int32)), pa.array(place)]
        return pa.RecordBatch.from_arrays([*rest.take(pa.array(owner)).columns, *columns], names)

    return work


def _located(plan: np.ndarray):
    """Column function from a piece's length and number to its sequence and offset."""

    def run(length: pa.Array, number: pa.Array) -> pa.Array:
        size, place = (c.to_numpy(zero_copy_only=False) for c in (length, number))
        key = plan[:, 0] << 48 | plan[:, 1]
        row = plan[np.searchsorted(key, size << 48 | place, "right") - 1]
        sequence, copy = np.divmod(place - row[:, 1], row[:, 2])
        return pa.StructArray.from_arrays(
            [pa.array(row[:, 4] + sequence), pa.array(row[:, 3] + copy * size)],
            ["sequence_id", "offset"],
        )

    run.__annotations__ = {"length": pa.Array, "number": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """A row per piece: the columns of ``docs`` without the text, and ``ADDED``.

    ``tokenizer`` is the path of the tokenizer's file on the executors; none is the public default.
    """
    spark = docs.sparkSession
    given = [c for c in docs.columns if c != text and c not in ADDED]
    source, task, place = (unused(docs, n) for n in ("text", "task", "place"))
    narrow = docs.select(
        *[F.col(f"`{c}`") for c in given], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(source)
    )
    schema = T.StructType([f for f in narrow.schema if f.name != source])
    kinds = ((T.IntegerType, "piece", task), (T.LongType, "start", "length", place), (T.BinaryType, "ids"))
    kind = {name: of() for of, *names in kinds for name in names}
    for name in ("piece", "start", "length", "ids", task, place):
        schema = schema.add(name, kind[name])
    path = workspace(spark, "pieces")
    names = schema.names
    cut = map_texts(narrow, source, schema, lambda: _pieces(names, tokenizer, capacity, end_id))
    cut.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)

    # how many pieces of each length a task has, and how many the tasks before it have
    path = workspace(spark, "piece-counts")
    counted = pieces.groupBy(F.col("length").alias("_l"), F.col(task).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_l").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    counted.select("_l", "_t", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).write.parquet(path)
    counted = spark.read.parquet(path)
    totals = counted.groupBy("_l").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("tasks")).collect()
    plan = packing_plan({r["_l"]: r["n"] for r in totals}, capacity)

    before = counted.select("_l", "_t", "_before")
    if sum(r["tasks"] for r in totals) <= broadcast_rows:
        before = F.broadcast(before)
    numbered = pieces.join(before, (F.col("length") == F.col("_l")) & (F.col(task) == F.col("_t")))
    spot = _located(plan)(F.col("length"), F.col("_before") + F.col(place))
    given = [F.col(f"`{c}`") for c in pieces.columns if c not in (task, place)]
    return numbered.select(*given, spot.alias("_spot")).select(*given, "_spot.sequence_id", "_spot.offset")
