"""Line deduplication with two Bloom filters.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points in at least ``min_docs`` documents lose all their lines except in the
largest ``doc_id`` that holds them.

1. Every task puts the keys of its documents (each once a document) in a *once* filter and, where
   that has them already, in a *twice* filter. The filters are cut in blocks; blocks of all tasks
   are merged by block number: ``twice`` also gets the bits that two ``once`` blocks share. A key
   of two documents is in the merged twice filter, whatever tasks read them.
2. The twice filter is broadcast: its size is the parameter ``filter_bits``, whatever the input.
   With more keys than it is made for, more keys are suspected; the result stays exact.
3. Only suspected repeats are shuffled, as SHA-256 of the key and ``doc_id``: documents per key are
   counted exactly and the keeping document is chosen.
4. Documents with lines to drop get the list of their keys and are rebuilt.

Defined results: a null or empty text is one empty line. Rows with the same ``doc_id`` are one
document in the count; each loses or keeps lines for itself. A null ``doc_id`` counts as one document
that is smaller than all others. Extra columns pass unchanged; ``n_lines``, ``n_dropped`` and ``kept``
replace columns of those names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscore.llm.arrow import row_udf

SPACE = " \t\n\v\f\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FILTER_BITS = 1 << 26
PROBES = 6
BLOCK_BYTES = 1 << 15
SALTS = 16


def line_key(line: str, min_chars: int) -> bytes | None:
    """SHA-256 of the line's key, None for keys that are too short."""
    line = line.strip(SPACE)
    if len(line) < min_chars:
        return None
    return sha256(line.encode("utf-8", "surrogatepass").translate(_LOWER)).digest()


def document_keys(text: str | None, min_chars: int) -> set[bytes]:
    """The distinct keys of a text."""
    keys = {line_key(line, min_chars) for line in (text or "").split("\n")}
    keys.discard(None)
    return keys


def bit_positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Filter positions of each key, ``(len(keys), PROBES)``, by double hashing."""
    words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 4)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (words[:, :1] + steps * (words[:, 1:2] | np.uint64(1))) & np.uint64(bits - 1)


class TwoFilters:
    """Bits of keys seen once and of keys seen again."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, keys: list[bytes]) -> None:
        """Add keys that are distinct among themselves."""
        if not keys:
            return
        at = bit_positions(keys, self.bits)
        byte, mask = at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        again = ((self.once[byte] & mask) != 0).all(axis=1)
        np.bitwise_or.at(self.twice, byte[again].ravel(), mask[again].ravel())
        np.bitwise_or.at(self.once, byte[~again].ravel(), mask[~again].ravel())

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(0, len(self.once), BLOCK_BYTES):
            once, twice = self.once[k : k + BLOCK_BYTES], self.twice[k : k + BLOCK_BYTES]
            if once.any():
                yield k // BLOCK_BYTES, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def suspected(keys: list[bytes], twice: np.ndarray) -> list[bytes]:
    """The keys that the twice filter has."""
    if not keys:
        return []
    at = bit_positions(keys, len(twice) * 8)
    mask = np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    seen = ((twice[at >> np.uint64(3)] & mask) != 0).all(axis=1)
    return [k for k, s in zip(keys, seen) if s]


def _block_table(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        ["block", "once", "twice"],
    )


def twice_filter(texts: DataFrame, min_chars: int, filter_bits: int) -> np.ndarray:
    """The merged twice filter of a table with the one column ``text``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(filter_bits)
        for batch in batches:
            for text in batch.column(0):
                filters.add(list(document_keys(text.as_py(), min_chars)))
        rows = list(filters.blocks())
        for k in range(0, len(rows), 64):
            yield _block_table(rows[k : k + 64])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(bytearray(zlib.decompress(p)), np.uint8) for p in parts)
                if block in merged:
                    before, again = merged[block]
                    again |= twice | (before & once)
                    before |= once
                else:
                    merged[block] = (once, twice)
        for block, (_, twice) in merged.items():
            yield _block_table([(block, b"", zlib.compress(twice.tobytes(), 1))])

    schema = "block int, once binary, twice binary"
    merged = (
        texts.mapInArrow(local, schema)
        .repartition(F.col("block"))
        .mapInArrow(merge, schema)
        .select("block", "twice")
    )
    out = np.zeros(filter_bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        start = row["block"] * BLOCK_BYTES
        part = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[start : start + len(part)] = part
    return out


def repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Row per document with lines to drop: ``doc_id, keys`` (SHA-256 of the keys to drop)."""
    shared = docs.sparkSession.sparkContext.broadcast(
        twice_filter(docs.select("text"), min_chars, filter_bits)
    )

    def make():
        twice = shared.value
        return lambda text: suspected(list(document_keys(text, min_chars)), twice)

    holder = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    suspects = docs.select(
        holder.alias("doc_id"),
        F.explode(row_udf("array<binary>", make)("text")).alias("key"),
    )
    repeated = (
        suspects.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("_docs"), F.max("doc_id").alias("_keeper"))
        .filter(F.col("_docs") >= min_docs)
        .select("key", "_keeper", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    )
    dealt = suspects.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return (
        dealt.join(repeated, ["key", "_salt"])
        .filter(F.col("doc_id") != F.col("_keeper"))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_lines(text: str | None, keys: list[bytes] | None, min_chars: int) -> tuple[int, int, str]:
    """Number of lines, number dropped, the text that stays."""
    lines = (text or "").split("\n")
    if not keys:
        return len(lines), 0, text or ""
    gone = set(keys)
    kept = [line for line in lines if line_key(line, min_chars) not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Add ``n_lines, n_dropped`` and ``kept`` (the text without the dropped lines)."""
    gone = repeated_lines(docs, min_chars, min_docs, filter_bits).select(
        F.col("doc_id").alias("_holder"), F.col("keys").alias("_keys")
    )
    rebuild = row_udf(
        "struct<n_lines:long,n_dropped:long,kept:string>",
        lambda: lambda text, keys: drop_lines(text, keys, min_chars),
    )
    holder = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return (
        docs.withColumn("_h", holder)
        .join(gone.hint("shuffle_hash"), F.col("_h") == F.col("_holder"), "left")
        .withColumn("_r", rebuild("text", "_keys"))
        .withColumns({c: F.col(f"_r.{c}") for c in ("n_lines", "n_dropped", "kept")})
        .drop("_r", "_h", "_holder", "_keys")
    )
