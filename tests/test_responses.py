"""Stateful assembly: each response once, late deltas kept, state freed, restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscore.operators import convert
from folioscore.plans import tables
from folioscore.session import workspace
from folioscore.streaming import responses

pytestmark = pytest.mark.integration
SCHEMA = "doc_id string, page_no int, seq int, delta string, is_last boolean, arrived timestamp"
START = datetime(2024, 1, 1)


def at(minute):
    return START + timedelta(minutes=minute)


class Feed:
    """Files of deltas, one micro-batch each, and the query over them."""

    def __init__(self, spark, name):
        self.spark, self.root, self.count = spark, workspace(spark, name), 0

    def add(self, *rows):
        df = self.spark.createDataFrame([(d, p, s, t, e, at(m)) for d, p, s, t, e, m in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, **options):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        query = responses.assemble_stream(
            stream, f"{self.root}/out", f"{self.root}/cp", delay="1 minute", idle_minutes=5, **options
        )
        query.awaitTermination()
        return query

    def given(self):
        return sorted(tuple(r) for r in responses.responses(self.spark, f"{self.root}/out").collect())

    def late(self):
        return sorted(tuple(r) for r in responses.late(self.spark, f"{self.root}/out").collect())


def test_each_response_once_and_late_deltas_kept(spark):
    feed = Feed(spark, "t-responses")
    feed.add(("a", 1, 1, "B", False, 0), ("b", 1, 0, "only ", False, 0))
    feed.add(("a", 1, 2, None, True, 1), ("a", 1, 0, "A", False, 1))  # out of order, a null delta
    query = feed.run()
    assert feed.given() == [("a", 1, "complete", "AB")] and feed.late() == []
    # after a restart: time goes on; b has no end and times out, a has been given out already
    feed.add(("c", 1, 0, "C", False, 9))
    feed.add(("a", 1, 3, "too late", False, 9), ("c", 1, 1, "!", True, 10))
    feed.add(("b", 1, 1, "after", False, 10))
    feed.run()
    assert feed.given() == [
        ("a", 1, "complete", "AB"),
        ("b", 1, "timed out", "only "),
        ("c", 1, "complete", "C!"),
    ]
    assert feed.late() == [("a", 1, 3, "too late"), ("b", 1, 1, "after")]
    # the marks are freed as well; what comes for a response long after is late all the same
    feed.add(("z", 1, 0, "z", True, 60))
    feed.add(("b", 1, 2, "very late", False, 2), ("b", 1, 3, "new time", False, 61))
    feed.add(("z", 2, 0, "z", True, 90))
    feed.add(("z", 3, 0, "z", True, 120))
    query = feed.run()
    assert len(feed.given()) == 6 and [r for r in feed.given() if r[0] == "b"] == [("b", 1, "timed out", "only ")]
    assert {r[3] for r in feed.late()} == {"too late", "after", "very late", "new time"}
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows[-1] <= 4  # the last marks and their timers


def test_equal_to_the_batch(spark, tiny):
    whole = tables.timed_chunks(spark.read.parquet(f"{tiny}/conversations.parquet"))
    root = workspace(spark, "t-timed")
    whole.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    responses.assemble_stream(stream, f"{root}/out", f"{root}/cp").awaitTermination()
    got = responses.responses(spark, f"{root}/out")
    want = convert.assemble_chunks(whole.select("doc_id", "page_no", "seq", "delta"))
    assert got.where("status <> 'complete'").isEmpty() and responses.late(spark, f"{root}/out").isEmpty()
    assert got.count() == want.count()
    assert got.select("doc_id", "page_no", "markdown").exceptAll(want).isEmpty()


def test_batch_that_runs_again_gives_nothing_twice(spark):
    feed = Feed(spark, "t-again")
    feed.add(("a", 1, 0, "A", True, 0))
    feed.run()
    first = feed.given()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{feed.root}/in")
    responses.assemble_stream(stream, f"{feed.root}/out", f"{feed.root}/other").awaitTermination()
    assert feed.given() == first == [("a", 1, "complete", "A")] and feed.late() == []


def test_other_streams_keep_their_state_store(spark):
    before = spark.conf.get(responses.STATE_STORE, None)
    feed = Feed(spark, "t-conf")
    feed.add(("a", 1, 0, "A", True, 0))
    feed.run()
    assert spark.conf.get(responses.STATE_STORE, None) == before and responses.ROCKSDB != before


def test_late_rows_reach_the_side_table_with_nothing_open(spark):
    feed = Feed(spark, "t-late")
    feed.add(("a", 1, 0, "A", True, 100))
    feed.add(("n", 1, 0, "never opened", True, 5))
    feed.add(("z", 1, 0, "z", True, 101))
    feed.run()
    assert [r[0] for r in feed.given()] == ["a", "z"]
    assert feed.late() == [("n", 1, 0, "never opened")]
    assert responses.late(spark, f"{feed.root}/out").select(F.count("*")).first()[0] == 1
