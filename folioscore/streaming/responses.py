"""Responses assembled from deltas as they arrive, each given out once.

A response is open from its first delta on. It is given out when its last delta (``is_last``) and all before it
have come, with status ``complete``; or, with status ``timed out``, when the watermark has passed the newest
arrival of its deltas by ``idle``. Then its deltas are freed. Until the watermark passes the newest arrival
by ``idle`` once more, a mark remembers that it is closed, so the state holds no more than the responses of about
twice that time.

A delta of a closed response, and one that is behind the watermark and belongs to no open one, is late. Late
deltas are no part of a response any more; they are kept in a table of their own. The sink looks up what it
gave out before, so the remains of a response whose mark is gone are late as well, whenever they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyspark.sql.types as T
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from folioscore.streaming.store import BATCH, RunStore, Table

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ("doc_id", "page_no")
RESULT = "doc_id string, page_no int, status string, markdown string, seq int, delta string"
TABLES = {
    "responses": Table("doc_id string, page_no int, status string, markdown string", KEYS),
    "late": Table("doc_id string, page_no int, seq int, delta string, at_batch long, nth long", (*KEYS, "at_batch", "nth")),
}


class Assembler(StatefulProcessor):
    """State of one response: its deltas, what is known of its end, and its timer."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deltas = handle.getListState("deltas", "seq int, delta string")
        # newest arrival, place of the last delta (-1: not come), timer, whether it was given out
        self.told = handle.getValueState("told", "newest long, last int, timer long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        newest, last, timer, closed = self.told.get() or (-1, -1, -1, False)
        arrived = sorted(rows, key=lambda r: (r["seq"], r["delta"] or ""))
        taken = []
        for r in arrived:
            if closed or (timer < 0 and not taken and r["at"] <= watermark):
                yield self._row(key, "late", None, r["seq"], r["delta"])
                continue
            taken.append((r["seq"], r["delta"]))
            newest = max(newest, r["at"])
            if r["is_last"]:
                last = max(last, r["seq"])
        if not taken:
            return
        self.deltas.appendList(taken)
        if last >= 0:
            held = list(self.deltas.get())
            if len({seq for seq, _ in held if seq <= last}) == last + 1:
                yield self._row(key, "complete", _joined(held), None, None)
                self.deltas.clear()
                closed = True
        self.told.update((newest, last, self._moved(timer, newest + self.idle_ms), closed))

    def handleExpiredTimer(  # noqa: N802
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo  # noqa: N803
    ) -> Iterator[Row]:
        newest, last, timer, closed = self.told.get() or (-1, -1, -1, True)
        if closed:
            self.told.clear()
            return
        yield self._row(key, "timed out", _joined(self.deltas.get()), None, None)
        self.deltas.clear()
        until = expiredTimerInfo.getExpiryTimeInMs() + self.idle_ms
        self.handle.registerTimer(until)
        self.told.update((newest, last, until, True))

    def close(self) -> None:
        pass

    def _moved(self, timer: int, until: int) -> int:
        if timer != until:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
        return until

    @staticmethod
    def _row(key: tuple, status: str, markdown: str | None, seq: int | None, delta: str | None) -> Row:
        return Row(doc_id=key[0], page_no=key[1], status=status, markdown=markdown, seq=seq, delta=delta)


def _joined(held) -> str:
    return "".join(delta or "" for _, delta in sorted(held, key=lambda x: (x[0], x[1] or "")))


def response_store(spark: SparkSession, out: str, **options: int) -> RunStore:
    """The tables ``responses`` and ``late``; options as of ``RunStore``."""
    return RunStore(spark, out, TABLES, **options)


def assemble_stream(
    chunks: DataFrame,
    out: str,
    checkpoint: str,
    delay: str = "10 minutes",
    idle_minutes: float = 10,
    trigger: dict | None = None,
    **options: int,
) -> StreamingQuery:
    """Assemble ``(doc_id, page_no, seq, delta, is_last, arrived)``; ``responses`` and ``late`` read the results.

    ``delay`` is how far behind the newest arrival the watermark stays. The state is kept by RocksDB, as timers need;
    the session's setting is only changed while the query starts.
    """
    spark = chunks.sparkSession
    # the arrival goes on as a number, so that Spark does not drop what is behind the watermark
    timed = chunks.withWatermark("arrived", delay).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("page_no").cast("int").alias("page_no"),
        F.col("seq").cast("int").alias("seq"),
        F.col("delta").cast("string").alias("delta"),
        F.coalesce("is_last", F.lit(False)).alias("is_last"),
        F.unix_millis("arrived").alias("at"),
    )
    rows = timed.groupBy(*KEYS).transformWithState(
        Assembler(int(idle_minutes * 60_000)), T._parse_datatype_string(RESULT), "update", "eventTime"
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        store = response_store(batch.sparkSession, out, **options)
        if store.manifest().last_batch >= batch_id:
            # the results are there already; the state of this batch has to be made all the same
            batch.write.format("noop").mode("overwrite").save()
            return
        batch = batch.persist()
        try:
            done = batch.where("status <> 'late'").select(*KEYS, "status", "markdown")
            before = store.read("responses", done).select(*KEYS).distinct()
            again = done.join(before, list(KEYS), "left_semi")
            late = batch.where("status = 'late'").select(*KEYS, "seq", "delta").unionByName(
                again.select(*KEYS, F.lit(None).cast("int").alias("seq"), F.col("markdown").alias("delta"))
            )
            number = F.monotonically_increasing_id()
            late = late.select("*", F.lit(batch_id).cast("long").alias("at_batch"), number.alias("nth"))
            staged = {
                "responses": store.stage("responses", done.join(before, list(KEYS), "left_anti"), batch_id),
                "late": store.stage("late", late, batch_id),
            }
            store.commit(batch_id, staged)
            store.compact()
        finally:
            batch.unpersist()

    writer = (
        rows.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    # a query keeps the settings it was started with; other streams of the session keep their own
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def responses(spark: SparkSession, out: str) -> DataFrame:
    """Responses given out so far: ``doc_id, page_no, status, markdown``."""
    return response_store(spark, out).read("responses").drop(BATCH)


def late(spark: SparkSession, out: str) -> DataFrame:
    """Late deltas: ``doc_id, page_no, seq, delta``; ``seq`` is null for what was assembled already."""
    return response_store(spark, out).read("late").select(*KEYS, "seq", "delta")
