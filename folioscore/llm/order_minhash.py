"""Near-duplicates by order MinHash, verified by banded alignment.

Similarity of two texts is ``1 - d / n``: ``d`` the edit distance in words, ``n`` the words of the
longer one. Words are runs of digits, letters and characters outside ASCII, A-Z lower-cased.

1. A text's k-mers are its runs of ``KMER`` = 5 words, each labelled with how often it came before.
   Each of ``SKETCHES`` hash functions picks the ``LENGTH`` least labelled k-mers; the sketch is these
   k-mers in the order of the text. Two texts share a sketch if they share the least k-mers in the same
   order, so sketches tell reordered texts apart.
2. Equal texts are one node. Nodes with the same sketch form a bucket; the least node of a bucket leads
   it, and each member is first a candidate for its leader only, so that copies cost one comparison
   each. Members that verification parts from their leader choose a leader among themselves, and so
   on for ``ROUNDS`` rounds.
3. A candidate is verified by alignment along diagonals, in a band as wide as the edits that the
   threshold allows, after a bound from the words the two texts share.
4. The rest is exact: in a bucket that holds more than one component of the links so far, every pair
   of nodes of different components is a candidate, unless their words rule it out: of ``n`` words
   near texts have all but ``(1 - similarity) n`` in common, and counts of the words by ``CELLS`` hash
   values bound how many they share. A bucket is dealt to tiles of about ``TILE`` nodes, every two tiles
   are compared in one task, and only pairs that the counts allow leave it, each from one bucket. Each
   node's ``MORE`` likeliest partners are verified first, then the next ones, ``MORE`` times as many each
   time, until every pair is verified or within one component.
5. Classes are the connected components of the verified links: those of all near pairs that share
   a sketch.

Nodes are named by 128 bits of a SHA-256. Texts are shuffled only to verify candidates.

Defined results: a null text is a class of its own row by row; texts without words are near-duplicates
only of equal texts. A class is named by its least ``doc_id``; a class whose ids are all null has the
name null. Rows with equal ``doc_id`` and text are one document each, in one class.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscore.llm.arrow import row_udf
from folioscore.llm.components import connected_components
from folioscore.llm.decontaminate import _TABLE
from folioscore.llm.texthash import mix, word_hashes
from folioscore.session import workspace

KMER = 5
LENGTH = 3
SKETCHES = 24
ROUNDS = 3
MORE = 16
CELLS = 1024
TILE = 512
SIMILARITY = 0.8
_CELLS = 1 << 20
_FULL = 2**16 - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def labelled_kmers(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers in order, and of the k-mers with their number of earlier occurrences."""
    words = word_hashes(_words(text))
    n = len(words)
    size = min(KMER, n)
    if not n:
        return words, words
    kmers = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        kmers = mix(kmers * _ODD + words[k : n - size + 1 + k])
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    earlier = np.empty(len(kmers), np.uint64)
    earlier[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    return kmers, mix(kmers + earlier * _ODD)


def sketches(text: str | None) -> list[int]:
    """One number per hash function; none for a text without words."""
    kmers, labelled = labelled_kmers(text)
    n = len(kmers)
    if not n:
        return []
    take = min(LENGTH, n)
    seeds = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _ODD)
    out = []
    step = max(1, _CELLS // n)
    for k in range(0, SKETCHES, step):
        seed = seeds[k : k + step, None]
        ranks = (labelled[None, :] ^ seed) * (seed | np.uint64(1))
        ranks ^= ranks >> np.uint64(32)
        ranks *= _ODD
        least = np.argpartition(ranks, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(seed), 1))
        least.sort(axis=1)
        sketch = seed[:, 0]
        for j in range(take):
            sketch = mix(sketch * _ODD + kmers[least[:, j]])
        out.append(sketch)
    return np.concatenate(out).astype(np.int64).tolist()


def _distance_by_bits(a: list, b: list, limit: int) -> int | None:
    """Edit distance if at most ``limit``: a column of the table at a time, its steps up and down as bits."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for done, word in enumerate(b, 1):
        same = places.get(word, 0)
        level = same | down
        flat = (((same & up) + up) ^ up) | same
        more, less = (down | ~(flat | up)) & full, up & flat
        score += bool(more & last) - bool(less & last)
        if score - (len(b) - done) > limit:
            return None
        more = more << 1 | 1
        up, down = (less << 1 | ~(level | more)) & full, more & level & full
    return score if score <= limit else None


def edit_distance(a: list, b: list, limit: int) -> int | None:
    """Edit distance if at most ``limit``: furthest points on the diagonals of the band.

    That costs the square of the edits; texts that are far apart go on as bit vectors.
    """
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    a, b = a[start:end_a], b[start:end_b]
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > limit:
        return None
    if not n or not m:
        return n + m
    # reach[k]: how much of a is aligned, at most, on diagonal k = (place in b) - (place in a)
    reach = {0: -1}
    for edits in range(limit + 1):
        if edits * edits > 2 * (n + m):
            return _distance_by_bits(a, b, limit)
        new = {}
        for k in range(-edits, edits + 1):
            if abs(goal - k) > limit - edits:
                continue
            i = reach.get(k, -2) + 1  # one word for another
            i = max(i, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)  # a word more, a word less
            if i < 0 or (edits and i + k < 0):
                continue
            i = min(i, n, m - k)
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            if k == goal and i >= n:
                return edits
            new[k] = i
        reach = new
    return None


def near(a: str | None, b: str | None, similarity: float = SIMILARITY) -> bool:
    """Whether two texts are at least that similar."""
    x, y = _words(a).split(), _words(b).split()
    longest = max(len(x), len(y))
    limit = most_edits(longest, similarity)
    shared = (Counter(x) & Counter(y)).total()
    if not longest or longest - shared > limit:
        return False
    return edit_distance(x, y, limit) is not None


def node_of(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; null for null."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root, class_id`` for every distinct text: the component and its least ``doc_id``."""
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = workspace(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    sketch = row_udf("array<long>", lambda: sketches)
    texts = docs.filter("text is not null").select("doc_id", node_of(F.col("text")).alias("node"), "text")
    nodes = kept(
        texts.select("doc_id", "node", sketch("text").alias("keys"))
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys")),
        "nodes",
    )
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    members = dealt
    links, failed, tried = None, None, None
    for _ in range(ROUNDS):
        leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("_n"))
        led = kept(
            members.join(leaders.filter("_n > 1").drop("_n"), "key").filter("node != leader"), "members"
        )
        pairs = led.select("node", "leader").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["node", "leader"], "left_anti")
        pairs = kept(pairs, "pairs")
        checked = kept(verified(pairs, texts, nodes, similarity), "checked")
        tried = checked if tried is None else tried.unionByName(checked)
        found = checked.filter("near").select(F.col("node").alias("a"), F.col("leader").alias("b"))
        links = found if links is None else links.unionByName(found)
        failed = tried.filter("not near").select("node", "leader")
        members = led.join(failed, ["node", "leader"], "left_semi").select("node", "key")
        if members.isEmpty():
            break
    roots = kept(connected_components(links), "roots")
    mixed = kept(_mixed(dealt, roots), "mixed")
    if not mixed.isEmpty():
        cells = row_udf("binary", lambda: word_cells)
        asked = _text_of(mixed.select("node").distinct(), texts, nodes)
        several = kept(asked.select("node", cells("text").alias("cells")).join(nodes.select("node", "keys"), "node"), "cells")
        pairs = _apart(mixed, several, similarity).join(tried, ["node", "leader"], "left_anti")
        pairs, most = kept(pairs, "pairs"), MORE
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "leader"))
        while not pairs.isEmpty():
            ranked = kept(pairs.withColumn("_place", place), "pairs")
            likely = ranked.filter(F.col("_place") <= most).select("node", "leader")
            checked = kept(verified(likely, texts, nodes, similarity), "checked")
            found = checked.filter("near").select(F.col("node").alias("a"), F.col("leader").alias("b"))
            roots = kept(_joined(roots, found), "roots")
            pairs = kept(_still_apart(ranked.filter(F.col("_place") > most).drop("_place"), roots), "pairs")
            most *= MORE
    named = nodes.select("node", "doc_id").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return kept(named.join(names, "root").select("node", "root", "class_id"), "classes")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, key, root`` of the buckets in which more than one component meets."""
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    rooted = members.join(shared, "key").join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"))
    return rooted.join(several.filter("_a <> _b").select("key"), "key").select("node", "key", "root")


def most_edits(n: int, similarity: float) -> int:
    """Most edits of near texts, the longer of which has ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def word_cells(text: str | None) -> bytes:
    """How many words have each of ``CELLS`` hash values."""
    cells = word_hashes(_words(text)) % np.uint64(CELLS)
    counts = np.bincount(cells.astype(np.int64), minlength=CELLS)
    return np.minimum(counts, _FULL).astype(np.uint16).tobytes()


def share_and_bound(one: np.ndarray, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of counts ``one`` and each column of ``others``: the share of words in common, at most, and whether it is enough."""
    some = np.flatnonzero(one)
    shared = np.minimum(others[some], one[some, None]).sum(0, dtype=np.int64)
    longest = np.maximum(others.sum(0, dtype=np.int64), one.sum(dtype=np.int64))
    most = ((1 - similarity) * longest + 1e-9).astype(np.int64)
    full = (others.max(0) == _FULL) | (one.max() == _FULL)  # counts that were too large to tell
    return shared / np.maximum(longest, 1), (longest - shared <= most) | full


def may_be_near(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether texts of these counts can share as many words as near texts do."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    return bool(share_and_bound(x, y[:, None], similarity)[1][0])


def labelled_words(text: str | None) -> list[int]:
    """Hashes of the words with their number of earlier occurrences: equal in two texts as often as both have them."""
    words = word_hashes(_words(text))
    seen: Counter = Counter()
    earlier = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words.tolist()):
        earlier[i] = seen[w]
        seen[w] += 1
    return mix(words + earlier * _ODD).astype(np.int64).tolist()


def _apart(mixed: DataFrame, several: DataFrame, similarity: float) -> DataFrame:
    """``node, leader, shared``: pairs of one bucket, in different components, that may be near by their counts.

    A task holds two tiles. A pair is given out once, by the bucket of the least key that its nodes share.
    """
    tiles = mixed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_tiles"))
    dealt = mixed.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node", "key"), F.col("_tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    dealt = dealt.select("node", "key", "root", "tile", other.alias("_other"))
    both = dealt.join(several, "node").select(
        "key", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j"),
        "tile", "node", "root", "cells", "keys",
    )

    def pairs(table: pa.Table) -> pa.Table:
        key, i, j = (table[c][0].as_py() for c in ("key", "i", "j"))
        tile = table["tile"].to_numpy()
        nodes, keys = table["node"].to_pylist(), table["keys"]
        roots = np.unique(np.array(table["root"].to_pylist(), "V16"), return_inverse=True)[1]
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint16).reshape(-1, CELLS)
        right = np.flatnonzero(tile == j)
        columns = np.ascontiguousarray(cells[right].T)
        sets: dict[int, set] = {}

        def keys_of(x: int) -> set:
            if x not in sets:
                sets[x] = set(keys[x].as_py())
            return sets[x]

        out = []
        for a in np.flatnonzero(tile == i).tolist():
            share, near = share_and_bound(cells[a], columns, similarity)
            near &= roots[right] != roots[a]
            if i == j:
                near &= right > a
            for at in np.flatnonzero(near).tolist():
                b = int(right[at])
                if min(keys_of(a) & keys_of(b)) == key:
                    out.append((max(nodes[a], nodes[b]), min(nodes[a], nodes[b]), float(share[at])))
        columns_out = list(zip(*out)) or [(), (), ()]
        kinds = (pa.binary(), pa.binary(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns_out, kinds)], names=["node", "leader", "shared"])

    return both.groupBy("key", "i", "j").applyInArrow(pairs, "node binary, leader binary, shared double")


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``node, root`` with the components that ``found`` links made one."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("_r1"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("_r2"))
    ends = found.join(left, "a", "left").join(right, "b", "left")
    between = ends.select(F.coalesce("_r1", "a").alias("a"), F.coalesce("_r2", "b").alias("b"))
    went = connected_components(between).select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    # a node that had no link is its own root
    alone = went.join(roots, went["_from"] == roots["node"], "left_anti").select(F.col("_from").alias("node"))
    every = roots.unionByName(alone.withColumn("root", F.col("node")))
    return every.join(went, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))


def _still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` whose nodes are in different components."""
    left = roots.select("node", F.col("root").alias("_r1"))
    right = roots.select(F.col("node").alias("leader"), F.col("root").alias("_r2"))
    rooted = pairs.join(left, "node", "left").join(right, "leader", "left")
    apart = F.coalesce("_r1", "node") != F.coalesce("_r2", "leader")
    return rooted.filter(apart).select(*pairs.columns)


def _text_of(asked: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the nodes asked for, from one row of each."""
    asked = asked.join(nodes.select("node", F.col("doc_id").alias("_id")), "node")
    return (
        texts.join(
            asked.withColumnRenamed("node", "_node").hint("shuffle_hash"),
            (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")),
        )
        .select("node", "text")
        .dropDuplicates(["node"])
    )


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``node, leader, near`` of candidate pairs. One row of each text that is in a pair is read."""
    asked = pairs.select("node").union(pairs.select(F.col("leader").alias("node"))).distinct()
    wanted = _text_of(asked, texts, nodes)
    left = wanted.select("node", F.col("text").alias("_a"))
    right = wanted.select(F.col("node").alias("leader"), F.col("text").alias("_b"))
    check = row_udf("boolean", lambda: lambda a, b: near(a, b, similarity))
    # alignments cost far more than the bytes of their texts tell, by which small shuffles are merged
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = pairs.join(left, "node").repartition(tasks, "leader").join(right, "leader")
    return both.select("node", "leader", check("_a", "_b").alias("near"))


def classify(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Row per document: ``doc_id, class_id`` (the least id of the documents it is near to)."""
    classes = near_duplicate_classes(docs, similarity).select("node", "class_id")
    named = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    return named.join(classes, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; rows with a null text stay."""
    classes = near_duplicate_classes(docs, similarity).select(
        F.col("node").alias("_node"), F.col("root").alias("_root"), F.col("class_id").alias("_class")
    )
    rows = docs.withColumn("_n", node_of(F.col("text")))
    leading = (
        rows.join(
            classes.hint("shuffle_hash"),
            (F.col("_n") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_class")),
        )
        .dropDuplicates(["_root"])
        .select(*docs.columns)
    )
    return leading.unionByName(docs.filter("text is null"))
