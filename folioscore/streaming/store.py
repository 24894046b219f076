"""Tables that grow batch by batch, kept as sorted runs that a manifest names.

Every batch appends one run per table. Where ``fanout`` runs of a level have gathered, they are
merged into one run of the next level that holds the newest row of every key, sorted and split
into shares by a hash of the document key. So after ``n`` batches there are at most ``fanout - 1`` runs of each of
about ``log n`` levels, every row has been rewritten about ``log n`` times, and a batch opens of each run
only the shares of its own documents.

``manifest/<number>.json`` lists the runs that count; the one with the highest number is valid. A
manifest is written after the runs that it names and appears as a whole. Whatever stops a batch or a
merge half way leaves folders that no manifest names and the last manifest as it was. Runs that a
merge replaced stay until the merge after it, for those who still read them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.sources import folder

BATCH = "batch_id"
MOST_SHARES = 4096
KEEP_MANIFESTS = 10


@dataclass(frozen=True)
class Run:
    """Rows of one table, in ``of`` shares (a power of two), of which ``shares`` have rows."""

    name: str
    level: int = 0
    of: int = 1
    shares: tuple[int, ...] = (0,)


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    last_batch: int = -1
    runs: dict[str, list[Run]] = field(default_factory=dict)
    replaced: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, number: int, text: str) -> Manifest:
        told = json.loads(text)
        runs = {t: [Run(**{**r, "shares": tuple(r["shares"])}) for r in rs] for t, rs in told["runs"].items()}
        return cls(number, told["last_batch"], runs, told["replaced"])

    def text(self) -> str:
        runs = {t: [asdict(r) for r in rs] for t, rs in self.runs.items()}
        return json.dumps({"last_batch": self.last_batch, "runs": runs, "replaced": self.replaced})


@dataclass(frozen=True)
class Table:
    """A table of a store: its schema (DDL) and the columns that name a row, the document key first."""

    schema: str
    key: tuple[str, ...]


class RunStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        tables: dict[str, Table],
        fanout: int = 8,
        share_bytes: int = 128 << 20,
    ):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.fanout, self.share_bytes = fanout, share_bytes

    def manifest(self) -> Manifest:
        numbers = self._manifests()
        if not numbers:
            return Manifest()
        return Manifest.of(numbers[-1], folder.read_text(self.spark, self._manifest_path(numbers[-1])))

    def _manifests(self) -> list[int]:
        found = folder.names(self.spark, f"{self.root}/manifest")
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())

    def _manifest_path(self, number: int) -> str:
        return f"{self.root}/manifest/{number}.json"

    def _put(self, manifest: Manifest) -> None:
        folder.write_text(self.spark, self._manifest_path(manifest.number), manifest.text())
        for old in self._manifests()[:-KEEP_MANIFESTS]:
            folder.remove(self.spark, self._manifest_path(old))

    def path(self, run: Run) -> str:
        return f"{self.root}/runs/{run.name}"

    def stage(self, table: str, rows: DataFrame, batch_id: int) -> Run:
        """Write the rows of a batch as a run that no manifest names yet."""
        run = Run(f"{table}-{batch_id}-{uuid.uuid4().hex}")
        stamped = rows.withColumn(BATCH, F.lit(batch_id).cast("long"))
        stamped.sortWithinPartitions(*self.tables[table].key).write.parquet(self.path(run))
        return run

    def commit(self, batch_id: int, staged: dict[str, Run]) -> None:
        """Make the runs of a batch count, all at once."""
        now = self.manifest()
        runs = {t: [*now.runs.get(t, []), *([staged[t]] if t in staged else [])] for t in self.tables}
        self._put(replace(now, number=now.number + 1, last_batch=batch_id, runs=runs))

    def read_run(self, table: str, run: Run, shares: Sequence[int] | None = None) -> DataFrame | None:
        """A run, or the part of it in these shares of ``MOST_SHARES``; none where it has no such rows."""
        schema = f"{self.tables[table].schema}, {BATCH} long"
        if run.of == 1:
            return self.spark.read.schema(schema).parquet(self.path(run))
        wanted = set(run.shares) if shares is None else {s % run.of for s in shares} & set(run.shares)
        if not wanted:
            return None
        paths = [f"{self.path(run)}/share={s}" for s in sorted(wanted)]
        return self.spark.read.schema(schema).parquet(*paths)

    def _share(self, table: str, of: int) -> Column:
        return F.pmod(F.xxhash64(self.tables[table].key[0]), F.lit(of)).cast("int")

    def read(self, table: str, documents: DataFrame | None = None) -> DataFrame:
        """Rows of all runs; with ``documents`` (the document key), only shares that have such documents.

        Of rows with one key the one of the last batch counts, see ``newest``.
        """
        runs = self.manifest().runs.get(table, [])
        shares = None
        if documents is not None and any(r.of > 1 for r in runs):
            found = documents.select(self._share(table, MOST_SHARES).alias("s")).distinct().collect()
            shares = [r["s"] for r in found]  # at most MOST_SHARES numbers
        parts = [p for r in runs if (p := self.read_run(table, r, shares)) is not None]
        if not parts:
            return self.spark.createDataFrame([], f"{self.tables[table].schema}, {BATCH} long")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def newest(self, table: str, rows: DataFrame) -> DataFrame:
        """Of each key the row of the last batch."""
        key = self.tables[table].key
        rest = [c for c in rows.columns if c not in key and c != BATCH]
        last = F.max_by(F.struct(*rest), BATCH).alias("_n")
        return rows.groupBy(*key).agg(last, F.max(BATCH).alias(BATCH)).select(*key, "_n.*", BATCH)

    def compact(self) -> bool:
        """Merge the levels that are full, lowest first; whether any was."""
        merged = False
        for table in self.tables:
            while (due := self._due(table)) is not None:
                self._merge(table, due)
                merged = True
        return merged

    def _due(self, table: str) -> list[Run] | None:
        runs = self.manifest().runs.get(table, [])
        for level in sorted({r.level for r in runs}):
            there = [r for r in runs if r.level == level]
            if len(there) >= self.fanout:
                return there
        # a batch that is large by itself is split into shares at once
        for run in runs:
            if run.level == 0 and folder.size(self.spark, self.path(run)) > self.share_bytes:
                return [run]
        return None

    def _merge(self, table: str, runs: list[Run]) -> None:
        size = sum(folder.size(self.spark, self.path(r)) for r in runs)
        of = 1
        while of * self.share_bytes < size and of < MOST_SHARES:
            of *= 2
        key = self.tables[table].key
        rows = self.read_run(table, runs[0])
        for run in runs[1:]:
            rows = rows.unionByName(self.read_run(table, run))
        rows = self.newest(table, rows)
        level = max(r.level for r in runs) + 1
        run = Run(f"{table}-L{level}-{uuid.uuid4().hex}", level, of, (0,))
        if of == 1:
            rows.coalesce(1).sortWithinPartitions(*key).write.parquet(self.path(run))
        else:
            # a document of very many rows keeps its share but is written by several tasks
            spread = F.pmod(F.xxhash64(*key), F.lit(16))
            (
                rows.withColumn("share", self._share(table, of))
                .repartition(of, "share", spread)
                .sortWithinPartitions("share", *key)
                .write.partitionBy("share")
                .parquet(self.path(run))
            )
            found = folder.names(self.spark, self.path(run))
            run = replace(run, shares=tuple(sorted(int(n[6:]) for n in found if n.startswith("share="))))
        now = self.manifest()
        gone = [r.name for r in runs]
        # runs stand in the order of their batches
        at = min(i for i, r in enumerate(now.runs[table]) if r.name in gone)
        left = [r for r in now.runs[table] if r.name not in gone]
        left.insert(at, run)
        self._put(replace(now, number=now.number + 1, runs={**now.runs, table: left}, replaced=gone))
        for name in now.replaced:
            folder.remove(self.spark, f"{self.root}/runs/{name}")
