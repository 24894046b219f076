"""Language-model scores by prediction by partial matching, beside a smoothed unigram base.

The model is a trie of byte contexts up to ``ORDER``, learnt from the training texts (escape method
C: a context that was seen ``T`` times with ``q`` different next bytes escapes with ``q / (T + q)``).
Symbol exclusion: after an escape, the bytes that the longer context has are taken out of the
shorter one. Because every byte that follows a context also follows its suffix, what is excluded
depends on the longer context alone, so counts and escape estimates after exclusion are made
once per context. A text is read with ``ORDER`` end marks before it and one after it.

Counting covers all training texts: every task counts the byte strings of its texts, and counts of
equal strings are summed after a shuffle. The table of strings, with the log probability of each in
its context, stays in the shared folder and grows with the texts; none is left out. The most
frequent strings, at most ``max_nodes``, are broadcast with these log probabilities. The other strings
of a document are counted per document, and each distinct one meets the trie: the table is dealt
out by the last ``SHARED`` bytes of the context, so all strings and contexts that a string escapes to
are in its own bucket, down to ``SHARED`` bytes of context. The orders below are broadcast whole:
their strings have at most ``SHARED`` bytes, so their number is bounded by the alphabet. Endings that more than
``bucket_rows`` strings have are parted by one more byte, and so on, so no bucket grows with its context; the
strings of the contexts between, at most 256 for each of at most ``MOST_ENDINGS`` endings of a length, are
broadcast as well.

Base: ``log10((c + 0.1) / (N + 0.1 (V + 1)))`` summed over the tokens of a text, words and one end.
The most frequent training words, at most ``hot_words``, are broadcast; the other words of a
document are counted per document and meet their training counts in a join. No word is cut.

Defined results: a null text is empty: one token, the end. Repeated documents are scored each for
itself. Without training texts the trie is empty and every byte has the probability 1/256.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscore.llm.arrow import map_texts
from folioscore.session import workspace

ORDER = 6
SYMBOLS = 256
END = 0xFF  # no byte of UTF-8
HOT_WORDS = 1 << 17
MAX_NODES = 2_750_000
SHARED = 3
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 64
MOST_ENDINGS = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASH = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)
_CHUNK = 1 << 21


def normal_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def tokens_of(data: bytes) -> list[bytes]:
    """Words between white space (space and control characters 9 to 13)."""
    return data.split()


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """Every byte of the text, and the end, with the ``order`` bytes before it, as one number."""
    a = np.frombuffer(bytes([END]) * order + data + bytes([END]), np.uint8).astype(np.uint64)
    n = len(a) - order
    out = a[:n].copy()
    for k in range(1, order + 1):
        out <<= np.uint64(8)
        out |= a[k : k + n]
    return out


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``context, gram, n`` of all texts (column ``text``), dealt out by context."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting, size = [], 0

        def settle():
            nonlocal keys, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, counts = _counted(np.concatenate([keys, new]), np.concatenate([counts, n]))

        for batch in batches:
            for text in batch.column(0):
                data = normal_bytes(text.as_py())
                waiting.append(grams(data, order))
                size += len(data) + 1
                if size >= _CHUNK:
                    settle()
                    waiting, size = [], 0
        if waiting:
            settle()
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[k : k + 100_000].astype(np.int64)), pa.array(counts[k : k + 100_000])],
                ["gram", "n"],
            )

    return (
        texts.mapInArrow(local, "gram long, n long")
        .withColumn("context", F.shiftright("gram", 8))
        .repartition("context")
        .groupBy("context", "gram")
        .agg(F.sum("n").alias("n"))
    )


def with_logs(counted: DataFrame) -> DataFrame:
    """``gram, n, log_prob``: natural log probability of every string in its whole context."""
    context = Window.partitionBy("context")  # at most 256 rows
    below = F.sum("n").over(context) + F.count(F.lit(1)).over(context)
    return counted.select("gram", "n", (F.log("n") - F.log(below)).cast("float").alias("log_prob"))


def most_counted(counted: DataFrame, count: str, most: int) -> DataFrame:
    """All rows, or those of the least count that leaves at most ``most``."""
    spread = (
        counted.groupBy(F.least(F.floor(8 * F.log2(count)), F.lit(400)).alias("level"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(count).alias("least"))
        .collect()
    )  # at most 401 rows
    left, least = 0, None
    for row in sorted(spread, key=lambda r: -r["least"]):
        left += row["rows"]
        if left > most:
            break
        least = row["least"]
    return counted.filter(F.col(count) >= least if least is not None else F.lit(False))


def bounded_grams(counted: DataFrame, max_nodes: int, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """The most counted strings in order, and a column of theirs."""
    rows = most_counted(counted, "n", max_nodes).select("gram", value).toArrow()
    keys = rows.column("gram").to_numpy().astype(np.uint64)
    return _counted(keys, rows.column(value).to_numpy())


def low_grams(counted: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings of ``size`` bytes with their counts."""
    low = F.col("gram").bitwiseAND(F.lit(256**size - 1)).alias("gram")
    rows = counted.groupBy(low).agg(F.sum("n").alias("n")).toArrow()
    return _counted(rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy())


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Table:
    """Open-addressed table of strings and their log probabilities.

    It is pickled as the two alone, so no executor stores the arrays made from them.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 1.5))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.uint64(2**bits - 1)
        self.slots = np.full(2**bits, _EMPTY)
        self.value = np.zeros(2**bits, np.float32)
        left = np.arange(len(keys))
        slot = (keys * _HASH) >> self.shift
        while len(left):
            free = self.slots[slot] == _EMPTY
            # of several keys for a free slot the last one written stays
            self.slots[slot[free]] = keys[left[free]]
            placed = self.slots[slot] == keys[left]
            self.value[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + np.uint64(1)) & self.mask

    def __reduce__(self):
        return Table, (self.keys, self.values)

    def look_up(self, wanted: np.ndarray) -> np.ndarray:
        """Log probabilities of strings; not a number where a string is not here."""
        slot = (wanted * _HASH) >> self.shift
        found = self.slots[slot]
        out = np.where(found == wanted, self.value[slot], np.float32(np.nan))
        place = np.flatnonzero((found != wanted) & (found != _EMPTY))
        slot = slot[place]
        while len(place):
            slot = (slot + np.uint64(1)) & self.mask
            found, left = self.slots[slot], wanted[place]
            hit = found == left
            out[place[hit]] = self.value[slot[hit]]
            on = ~hit & (found != _EMPTY)
            place, slot = place[on], slot[on]
        return out


def pieces(data: bytes, order: int) -> Iterator[np.ndarray]:
    """``grams`` of a text, of so many bytes at a time."""
    step = _CHUNK
    for k in range(0, len(data) + 1, step):
        before = data[max(0, k - order) : k]
        part = grams(data[k : k + step], order)
        if k:  # the true bytes before this part
            part = grams(before + data[k : k + step], order)[len(before) :]
        yield part if k + step > len(data) else part[:-1]


class Level:
    """One order of the trie: strings, contexts, and what holds after an escape from them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.counts = counts
        self.log_count = np.log(counts).astype(np.float32)
        context = keys >> np.uint64(8)
        self.contexts, self.first = np.unique(context, return_index=True)
        self.total = np.add.reduceat(counts, self.first) if len(keys) else np.empty(0, np.int64)
        self.kinds = np.diff(np.append(self.first, len(keys)))
        with np.errstate(divide="ignore"):
            self.log_all = np.log(self.total + self.kinds)
            self.log_escape = np.log(self.kinds) - self.log_all


class Model:
    """The trie with all logarithms (natural) made ready.

    ``keys`` may be those whose contexts end in some strings of ``d`` bytes, if ``lower`` has, by the length of
    the context, the strings with the contexts below ``d`` that these end in, with their counts in the whole trie.
    """

    def __init__(
        self,
        keys: np.ndarray,
        counts: np.ndarray,
        order: int = ORDER,
        lower: dict[int, tuple[np.ndarray, np.ndarray]] | None = None,
    ):
        self.order = order
        lower = lower or {}
        levels = []
        for d in range(order, -1, -1):
            levels.append(Level(keys, counts))
            if d - 1 in lower:
                keys, counts = lower[d - 1]
            elif d:
                keys, counts = _counted(keys & np.uint64(256**d - 1), counts)
        self.levels = levels[::-1]
        for d in range(order):
            self._exclude(self.levels[d + 1], self.levels[d], d)
        self._exclude_all()
        top = self.levels[order]
        own = np.repeat(np.arange(len(top.contexts)), top.kinds)
        self.table = Table(top.keys, (top.log_count - top.log_all[own]).astype(np.float32))
        for level in self.levels:
            del level.counts, level.total, level.first

    @staticmethod
    def _exclude(longer: Level, shorter: Level, d: int) -> None:
        """Totals of the shorter context without the bytes that the longer one has."""
        if not len(longer.keys):
            longer.log_all_below = longer.log_escape_below = np.empty(0)
            return
        suffix = _find(shorter.contexts, longer.contexts & np.uint64(256**d - 1))
        same = _find(shorter.keys, longer.keys & np.uint64(256 ** (d + 1) - 1))
        gone = np.add.reduceat(shorter.counts[same], longer.first)
        total = shorter.total[suffix] - gone
        kinds = shorter.kinds[suffix] - longer.kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            longer.log_all_below = np.log(total + kinds)
            longer.log_escape_below = np.where(kinds > 0, np.log(kinds) - longer.log_all_below, 0.0)

    def _exclude_all(self) -> None:
        lowest = self.levels[0]
        seen = int(lowest.kinds[0]) if len(lowest.kinds) else 0
        self.log_uniform = -np.log(max(SYMBOLS - seen, 1))

    def log_prob(self, data: bytes) -> float:
        """Natural log probability of a normal text and its end."""
        return sum(self._score(part) for part in pieces(data, self.order))

    def _score(self, wanted: np.ndarray) -> float:
        logs = self.table.look_up(wanted)
        missing = np.isnan(logs)
        return float(logs[~missing].sum(dtype=np.float64)) + float(self.log_probs(wanted[missing]).sum())

    def log_probs(self, strings: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each string."""
        out = np.zeros(len(strings))
        wanted, place = strings, np.arange(len(strings))
        longer = np.full(len(wanted), -1)
        for d in range(self.order, -1, -1):
            if not len(wanted):
                return out
            level = self.levels[d]
            own = wanted & np.uint64(256 ** (d + 1) - 1)
            at = _find(level.keys, own)
            context = _find(level.contexts, own >> np.uint64(8))
            after = longer >= 0
            all_, escape = np.zeros(len(wanted)), np.zeros(len(wanted))
            fresh = ~after & (context >= 0)
            all_[fresh], escape[fresh] = level.log_all[context[fresh]], level.log_escape[context[fresh]]
            if d < self.order:
                above = self.levels[d + 1]
                all_[after] = above.log_all_below[longer[after]]
                escape[after] = above.log_escape_below[longer[after]]
            hit = at >= 0
            out[place[hit]] += level.log_count[at[hit]] - all_[hit]
            out[place[~hit]] += escape[~hit]
            wanted, place, longer = wanted[~hit], place[~hit], context[~hit]
        out[place] += self.log_uniform
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts (column ``text``), words as bytes."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            items = list(counts.items())
            counts.clear()
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())],
                    ["word", "c"],
                )

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens_of(normal_bytes(text.as_py())))
                if len(counts) > 300_000:
                    yield from out()
        yield from out()

    return texts.mapInArrow(local, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _ending(length: int) -> Column:
    """The last ``length`` bytes of a string's context."""
    return F.shiftright("gram", 8).bitwiseAND(F.lit(256**length - 1))


def hot_endings(strings: DataFrame, wanted: DataFrame, order: int, most: int) -> dict[int, DataFrame]:
    """By length, endings of contexts that more than ``most`` strings have, from ``SHARED`` bytes on.

    Each table has at most a row for ``most`` strings.
    """
    rows = strings.select("gram").union(wanted.select("gram"))
    hot: dict[int, DataFrame] = {}
    for length in range(SHARED, order):
        counted = rows.groupBy(_ending(length).alias("ending")).agg(F.count(F.lit(1)).alias("rows"))
        path = workspace(rows.sparkSession, "endings")
        counted.filter(F.col("rows") > most).select("ending").write.parquet(path)
        found = rows.sparkSession.read.parquet(path)
        if found.isEmpty():
            break
        hot[length] = found
        rows = rows.join(F.broadcast(found), _ending(length) == F.col("ending"), "left_semi")
    return hot


def log_probs_of(
    wanted: DataFrame, strings: DataFrame, order: int, buckets: int, most: int = BUCKET_ROWS
) -> DataFrame:
    """``gram, log_prob`` of the distinct strings ``wanted``, by the trie of all ``strings``.

    Strings go to a bucket by the last ``SHARED`` bytes of their context, or by as many more as it takes
    for at most ``most`` strings to have them. For a longer ending, the strings of the contexts
    between are sent along: at most 256 for each ending that was parted.
    """
    spark = wanted.sparkSession
    hot = hot_endings(strings, wanted, order, most) if order >= SHARED else {}
    lower = {SHARED - 1: low_grams(strings, SHARED)} if order >= SHARED else {}
    for length, endings in hot.items():
        parted = strings.join(F.broadcast(endings), _ending(length) == F.col("ending"), "left_semi")
        lower[length] = low_grams(parted, length + 1)
    sent = spark.sparkContext.broadcast(lower)

    def dealt(rows: DataFrame) -> DataFrame:
        if order < SHARED:
            return rows.withColumn("depth", F.lit(0)).withColumn("bucket", F.lit(0).cast("long"))
        rows = rows.withColumn("depth", F.lit(SHARED)).withColumn("end", _ending(SHARED))
        for length, endings in hot.items():
            parted = F.broadcast(endings.withColumn("longer", F.lit(True)))
            on = (F.col("depth") == length) & (F.col("end") == F.col("ending"))
            rows = rows.join(parted, on, "left")
            for name, value in (("end", _ending(length + 1)), ("depth", F.lit(length + 1))):
                rows = rows.withColumn(name, F.when(F.col("longer"), value).otherwise(F.col(name)))
            rows = rows.drop("ending", "longer")
        return rows.withColumn("bucket", F.pmod(F.xxhash64("depth", "end"), F.lit(buckets))).drop("end")

    def score(key: tuple, known: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"gram": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64())})
        keys, counts = _counted(known["gram"].to_numpy().astype(np.uint64), known["n"].to_numpy())
        depth = key[0].as_py()
        model = Model(keys, counts, order, {d: t for d, t in sent.value.items() if d < depth})
        grams_ = asked["gram"].to_numpy()
        return pa.table({"gram": grams_, "log_prob": model.log_probs(grams_.astype(np.uint64))})

    return (
        dealt(strings.select("gram", "n"))
        .groupBy("depth", "bucket")
        .cogroup(dealt(wanted.select("gram")).groupBy("depth", "bucket"))
        .applyInArrow(score, "gram long, log_prob double")
    )


def windows(data: list[bytes], order: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``grams`` of many texts, and the place of the text of each, about ``step`` at a time."""
    pad, end = bytes([END]) * order, bytes([END])
    a = np.frombuffer(b"".join(pad + d + end for d in data), np.uint8)
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    first = np.cumsum(sizes + order) - sizes - order
    for low in range(0, len(a) - order, step):
        high = min(low + step, len(a) - order)
        part = a[low : high + order].astype(np.uint64)
        keys = part[: high - low].copy()
        for k in range(1, order + 1):
            keys <<= np.uint64(8)
            keys |= part[k : k + high - low]
        # windows that begin in the bytes before a text's end mark belong to no text
        begin, stop = np.maximum(first, low), np.minimum(first + sizes, high)
        times = np.maximum(stop - begin, 0)
        text_of = np.repeat(np.arange(len(data)), times)
        at = np.arange(len(text_of)) + np.repeat(begin - low - np.cumsum(times) + times, times)
        yield keys[at], text_of


def _scores(names: list[str], frequent, hot, order: int, ends: int, end_score: float):
    """Function of the texts of a task: scores by what is broadcast, and the words and strings that are not."""

    def make():
        table, known = frequent.value, hot.value

        def work(texts: pa.Array, rest: pa.RecordBatch) -> pa.RecordBatch:
            data = [t.translate(_LOWER) if t else b"" for t in texts.to_pylist()]
            n = len(data)
            words = [tokens_of(d) for d in data]
            n_words = np.fromiter(map(len, words), np.int64, n)
            flat = list(chain.from_iterable(words))
            del words
            word_of = np.repeat(np.arange(n), n_words)
            logs = np.fromiter(map(known.get, flat, repeat(np.nan)), np.float64, len(flat))
            rare = np.flatnonzero(np.isnan(logs))
            n_rare = np.bincount(word_of[rare], minlength=n)
            base = np.bincount(word_of, np.nan_to_num(logs), minlength=n) + end_score

            score, keys, owners = np.zeros(n), [], []
            for part, text_of in windows(data, order, _CHUNK // 2):
                logs = table.look_up(part)
                missing = np.isnan(logs)
                score += np.bincount(text_of, np.where(missing, 0, logs), minlength=n)
                keys.append(part[missing])
                owners.append(text_of[missing])
            key, owner = np.concatenate(keys), np.concatenate(owners)
            by_text = np.lexsort((key, owner))
            key, owner = key[by_text], owner[by_text]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)]
            place = np.flatnonzero(new)
            times = np.diff(np.append(place, len(key)))

            def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), values)

            n_keys = np.bincount(owner[place], minlength=n)
            made = [
                pa.array(n_words + 1),
                pa.array(n_words - n_rare + int(ends > 0)),
                pa.array(base),
                pa.array(score),
                lists(pa.array([flat[i] for i in rare.tolist()], pa.binary()), n_rare),
                lists(pa.array(key[place].astype(np.int64)), n_keys),
                lists(pa.array(times), n_keys),
            ]
            return pa.RecordBatch.from_arrays([*rest.columns, *made], names)

        return work

    return make


def score_documents(
    docs: DataFrame,
    train: Column,
    order: int = ORDER,
    max_nodes: int = MAX_NODES,
    hot_words: int = HOT_WORDS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` says which documents are learnt from.
    """
    spark = docs.sparkSession
    learnt = docs.filter(train).select("text")
    grams_at, words_at, scored_at = (workspace(spark, n) for n in ("grams", "words", "scored"))
    with_logs(count_grams(learnt, order)).write.parquet(grams_at)
    word_counts(learnt).write.parquet(words_at)
    strings = spark.read.parquet(grams_at)
    frequent = spark.sparkContext.broadcast(Table(*bounded_grams(strings, max_nodes, "log_prob")))
    words = spark.read.parquet(words_at)
    ends = learnt.count()
    whole = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total = (whole["n"] or 0) + ends
    divisor = total + 0.1 * (whole["v"] + (ends > 0) + 1)
    top = most_counted(words, "c", hot_words).toArrow()
    hot = spark.sparkContext.broadcast(
        dict(
            zip(
                top.column("word").to_pylist(),
                np.log10((top.column("c").to_numpy() + 0.1) / divisor).tolist(),
            )
        )
    )
    end_score = float(np.log10((ends + 0.1) / divisor))
    schema = T.StructType([f for f in docs.select("doc_id").schema])
    for names, kind in (
        (("n_tokens", "n_known"), T.LongType()),
        (("hot_score", "score"), T.DoubleType()),
        (("words",), T.ArrayType(T.BinaryType())),
        (("grams", "gram_counts"), T.ArrayType(T.LongType())),
    ):
        for name in names:
            schema = schema.add(name, kind)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = map_texts(texts, "text", schema, _scores(schema.names, frequent, hot, order, ends, end_score))
    made.withColumn("row", F.monotonically_increasing_id()).write.parquet(scored_at)
    scored = spark.read.parquet(scored_at)
    log = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / divisor)
    rare = (
        scored.select("row", F.explode("words").alias("word"))
        .join(words, "word", "left")
        .groupBy("row")
        .agg(F.sum(log).alias("rare_score"), F.count("c").alias("rare_known"))
    )
    others = scored.select(
        "row", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("gram_counts").alias("n")))
    )
    size = strings.count() + (scored.agg(F.sum(F.size("grams"))).first()[0] or 0)
    buckets = max(LEAST_BUCKETS, size // bucket_rows)
    most = max(bucket_rows, size // MOST_ENDINGS)
    logs = log_probs_of(others.select("gram").distinct(), strings, order, buckets, most)
    in_trie = others.join(logs, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log_prob")).alias("trie_score"))
    none = F.lit(0)
    left = scored.drop("words", "grams", "gram_counts")
    return left.join(rare, "row", "left").join(in_trie, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", none)).alias("base_score"),
        ((F.col("score") + F.coalesce("trie_score", none)) / float(np.log(10))).alias("score"),
    )
