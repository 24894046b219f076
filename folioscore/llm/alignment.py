"""Tokens of two tokenizers over the same text, aligned by their bytes.

``A`` is byte-level BPE over a space and the text, ``B`` is BPE with byte fallback over the text (it puts
the space before it by itself). Tokens stand for bytes: an entry of A is decoded from its byte-level
letters, a piece of B is its UTF-8 with U+2581 as a space, and ``<0xHH>`` is a byte. A text that is null,
empty, or whose joined bytes differ from a space and the text in A or B has no tokens.

* *Groups* by pointer jumping. Every token points to the token that overlaps it and ends farthest to the
  right; of two that end alike, to A's, and A's to itself. Replacing every pointer by its target's pointer, for all
  tokens at once, halves the way that is left in each round, until each token points to the last token of
  its component: tokens with equal targets are a group. Groups end where A and B both end. A piece of
  many texts is worked on as one string of bytes, since texts end at a common place.
* *Links* are all pairs of an A and a B token whose byte ranges overlap.
* *Counts* of linked id pairs are summed over all texts: distinct pairs of a batch leave the tasks and are
  summed after a shuffle. The most frequent pairs, at most ``hot_pairs``, are broadcast; links of other pairs
  are counted by text and meet their counts in a join, so nothing is left out.
  The highest count of every B id is a table no longer than B's vocabulary.

Aligned texts are written to the shared folder once and read for the counts and for the scores.

Neither joins anything over a single space between words, so a worker keeps the ids of words that come again.

Defined results: texts without tokens have zeros and an empty group string. Repeated rows are aligned each
for itself and all count. An empty table gives no rows. Columns ``n_a, n_b, n_groups, groups, links`` and, from
``score_links``, ``n_links, n_best, count_sum`` are added; given columns of these names are replaced.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscore.llm.arrow import map_texts
from folioscore.llm.names import unused
from folioscore.llm.wordmemo import JoinedWords, WordMemo, in_a_row, per_text
from folioscore.session import workspace

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
_ODD = re.compile("^ | $|\\s | \\s|\u180e")
_BETWEEN = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
HOT_PAIRS = 1_000_000
#: Words whose ids a worker keeps, and bytes of text that it aligns at a time.
HELD_WORDS = 150_000
_PIECE = 1 << 18
_LINKS = 1 << 19
ALIGNED = ("n_a", "n_b", "n_groups", "groups", "links")
SCORED = ("n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def words_of(text: str) -> list[str]:
    """The text cut at single spaces with no white space beside them, without these spaces.

    Both tokenizers start a new token there and take the space in front, so the ids of the words, each
    with a space before it, are those of the text.
    """
    return _BETWEEN.split(text) if _ODD.search(text) else text.split(" ")


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_level: str | None = None, pieces: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_level or public_tokenizers.path(BYTE_LEVEL))
        self.a_words = JoinedWords(a, prefix=" ", as_text=True)
        letters = byte_letters()
        self.a_bytes = [b""] * (max(a.get_vocab().values()) + 1)
        for token, i in a.get_vocab().items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        self.b_bytes = [
            bytes([int(piece[3:5], 16)])
            if self.b.is_byte(i)
            else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        #: no piece goes over the start of a word, so words are encoded each for themselves
        self.apart = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.memo = WordMemo(self.encode_words, sides=2, most=HELD_WORDS)
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        if len(self.a_bytes) * len(self.b_bytes) > 1 << 31:
            raise ValueError("the vocabularies have too many pairs for 32 bits")

    def encode_words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B per word; a word whose bytes are not those of a space and it has none of either."""
        sides = [self.a_words(words), in_a_row(self.b.encode(words, num_threads=1))]
        spelt = [b" " + w.encode() for w in words]
        whole, lengths = b"".join(spelt), np.array([len(w) for w in spelt])
        for (ids, sizes), table, widths in zip(sides, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes)):
            same_lengths = np.array_equal(per_text(widths[ids], sizes), lengths)
            if not same_lengths or b"".join(map(table.__getitem__, ids.tolist())) != whole:
                return self._checked(spelt, sides)
        return sides

    def _checked(self, spelt: list[bytes], sides: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same, word by word."""
        good = np.ones(len(spelt), bool)
        for (ids, sizes), table in zip(sides, (self.a_bytes, self.b_bytes)):
            read, ends = list(map(table.__getitem__, ids.tolist())), np.cumsum(sizes).tolist()
            for i, (w, start, end) in enumerate(zip(spelt, [0, *ends], ends)):
                good[i] &= b"".join(read[start:end]) == w
        return [(ids[np.repeat(good, sizes)], np.where(good, sizes, 0)) for ids, sizes in sides]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side: ids of all texts in a row, and how many each text has."""
        words = [(words_of(t) if self.apart else [t]) if t else [] for t in texts]
        n_words = np.array([len(w) for w in words], np.int64)
        sides = self.memo.look_up([w for own in words for w in own])
        broken = per_text(sides[0][1] == 0, n_words) > 0
        out = []
        for ids, sizes in sides:
            n = per_text(sizes, n_words)
            out.append((ids[np.repeat(~broken, n)].astype(np.int64), np.where(broken, 0, n)))
        return out


@lru_cache(maxsize=2)
def tokenizers(byte_level: str | None = None, pieces: str | None = None) -> Tokenizers:
    """Both tokenizers with the ids of words, held by the worker."""
    return Tokenizers(byte_level, pieces)


def group_targets(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of A and of B: the A token that ends their group, by pointer jumping."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the B token that holds the last byte of an A token
    over_b = np.searchsorted(ends_a, ends_b)
    own = np.arange(n)
    points = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, own), over_b]) if n else over_b
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            return points[:n], points[n:]
        points = farther


def overlaps(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every overlapping pair, by A, then B."""
    first = np.searchsorted(ends_b, ends_a - sizes_a, "right")
    last = np.searchsorted(ends_b, ends_a)
    times = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), times)
    skipped = np.repeat(np.cumsum(times) - times, times)
    return a, np.repeat(first, times) + np.arange(len(a)) - skipped


def _id_texts(n_a: int, n_b: int) -> np.ndarray:
    """Ids with the mark that follows them: A inside a side and at its end, B likewise."""
    kinds = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
    width = len(str(max(n_a, n_b))) + 1
    return np.concatenate([np.array([f"{i}{mark}" for i in range(n)], f"S{width}") for n, mark in kinds])


def _align(names: list[str], byte_level: str | None, pieces: str | None):
    tools = tokenizers(byte_level, pieces)
    n_a, n_b = len(tools.a_bytes), len(tools.b_bytes)
    written = _id_texts(n_a, n_b)
    widths = np.char.str_len(written)

    def work(texts: pa.Array, rest: pa.RecordBatch) -> pa.RecordBatch:
        (a, count_a), (b, count_b) = tools.encode([t.decode() if t else "" for t in texts.to_pylist()])
        sizes_a = tools.a_sizes[a]
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(tools.b_sizes[b])
        group_a, group_b = group_targets(ends_a, ends_b)
        text_of = np.repeat(np.arange(len(texts)), count_a)
        n_groups = np.bincount(text_of[np.unique(group_a)], minlength=len(texts))

        # tokens by group, A before B; each id is written with the mark that follows it
        last_a = np.append(group_a[1:] != group_a[:-1], [True])[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], [True])[: len(b)]
        entry = np.concatenate([a + n_a * last_a, 2 * n_a + b + n_b * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        entry = entry[order]
        line = written[entry].tobytes().replace(b"\0", b"")
        token_ends = np.cumsum(widths[entry])
        stops = np.cumsum(count_a + count_b)
        text_ends = np.concatenate([[0], token_ends])[stops].tolist()
        groups, start = [], 0
        for end in text_ends:
            groups.append(line[start : max(end - 1, start)])
            start = end

        left, right = overlaps(ends_a, sizes_a, ends_b)
        codes = (a[left] * n_b + b[right]).astype(np.int32)
        n_links = np.bincount(text_of[left], minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
        made = [
            pa.array(count_a),
            pa.array(count_b),
            pa.array(n_groups),
            pa.array(groups, pa.binary()).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes)),
        ]
        return pa.RecordBatch.from_arrays([*rest.columns, *made], names)

    return work


def align(docs: DataFrame, text: str = "text", byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """``docs`` with the numbers of tokens and groups, the groups as ``a1,a2|b1;a3|b2`` and the links.

    The text is left out. A link is ``A's id * size of B's vocabulary + B's id``. Paths of the
    tokenizers' files hold on the executors.
    """
    given = [c for c in docs.columns if c != text and c not in ALIGNED]
    source = unused(docs, "text")
    narrow = docs.select(
        *[F.col(f"`{c}`") for c in given], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(source)
    )
    schema = T.StructType([f for f in narrow.schema if f.name != source])
    for name in ("n_a", "n_b", "n_groups"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("groups", T.StringType()).add("links", T.ArrayType(T.IntegerType()))
    names = schema.names
    return map_texts(narrow, source, schema, lambda: _align(names, byte_level, pieces), most_bytes=_PIECE)


def _distinct_links(batches):
    """Distinct pairs with how many links have them, of some links at a time."""
    for batch in batches:
        links = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        for k in range(0, len(links), _LINKS):
            pair, n = np.unique(links[k : k + _LINKS], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of all texts have an id pair."""
    partial = aligned.select("links").mapInArrow(_distinct_links, "pair int, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count for which at most ``most`` pairs have it or more."""
    taken = 0
    times = counts.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("n"))
    for row in times.limit(most + 1).toLocalIterator():
        taken += row["pairs"]
        if taken > most:
            return row["n"] + 1
    return 0


def _scores(names: list[str], sent, n_b: int):
    """Function of the links of some texts: their number, the best ones, their counts, and those of rare pairs."""

    def make():
        pairs, times, most = sent.value

        def work(links: pa.Array, rest: pa.RecordBatch) -> pa.RecordBatch:
            link = links.flatten().to_numpy(zero_copy_only=False)
            n_links = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
            distinct, back = np.unique(link, return_inverse=True)
            known, n = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, distinct), len(pairs) - 1)
                known = pairs[at] == distinct
                n = np.where(known, times[at], 0)
            best = known & (n == most[distinct % n_b])
            sums = [per_text(v[back], n_links) for v in (best.astype(np.int64), n)]
            rare = ~known[back]
            offsets = np.concatenate([[0], np.cumsum(per_text(rare.astype(np.int64), n_links))])
            made = [pa.array(n_links), *map(pa.array, sums)]
            made.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(link[rare])))
            return pa.RecordBatch.from_arrays([*rest.columns, *made], names)

        return work

    return make


def score_links(aligned: DataFrame, hot_pairs: int = HOT_PAIRS, pieces: str | None = None) -> DataFrame:
    """``aligned``, written and read back, with ``n_links``, ``n_best`` and ``count_sum`` and without the links.

    A pair's count is over all texts; a link is best if no other A id has a higher count with its B id.
    ``pieces`` is the file of B's tokenizer.
    """
    spark = aligned.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = workspace(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    n_b = len(tokenizers(None, pieces).b_bytes)
    rows = kept(aligned.drop(*SCORED), "aligned")
    counts = kept(pair_counts(rows), "pair-counts")
    b_id = (F.col("pair") % n_b).alias("b")
    highest = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    most = np.zeros(n_b, np.int64)  # by B id
    found = highest.toArrow()
    most[found["b"].to_numpy()] = found["most"].to_numpy()
    least = _least_count(counts, hot_pairs)
    hot = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), most))

    rare, row = unused(rows, "rare"), unused(rows, "row")
    schema = T.StructType([f for f in rows.schema if f.name != "links"])
    for name in SCORED:
        schema = schema.add(name, T.LongType())
    schema = schema.add(rare, T.ArrayType(T.IntegerType()))
    scored = map_texts(rows, "links", schema, _scores(schema.names, sent, n_b), most_bytes=_LINKS * 4)
    if not least:
        return scored.drop(rare)

    # links of other pairs: counted by text, met with their counts, summed by text
    scored = kept(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    links = scored.select(row, F.explode(rare).alias("pair")).groupBy(row, "pair").agg(F.count(F.lit(1)).alias("links"))
    top = F.broadcast(highest)  # a row for an id of B
    met = links.join(counts.filter(F.col("n") < least), "pair").withColumn("b", b_id).join(top, "b")
    sums = met.groupBy(F.col(row).alias("_r")).agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0)).alias("_best"),
        F.sum(F.col("links") * F.col("n")).alias("_sum"),
    )
    none = F.lit(0)
    given = [F.col(f"`{c}`") for c in scored.columns if c not in (row, rare, "n_best", "count_sum")]
    return scored.join(sums, F.col(row) == F.col("_r"), "left").select(
        *given,
        (F.col("n_best") + F.coalesce("_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", none)).alias("count_sum"),
    )
