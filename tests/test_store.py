"""The store of runs: compaction, crashes, bounded reads, and 50 batches of a stream."""

import pytest

from folioscore.operators import metrics
from folioscore.schemas import VARIANTS
from folioscore.session import workspace
from folioscore.sources import folder
from folioscore.streaming import variants as variant_stream
from folioscore.streaming.store import RunStore, Table

TABLES = {"t": Table("doc string, k int, v string", ("doc", "k"))}


def batch(spark, b, docs=12):
    rows = [(f"d{i}", j, f"{b}") for i in range(docs) for j in range(3) if (i + j + b) % 4 == 0]
    return rows, spark.createDataFrame(rows, "doc string, k int, v string")


def add(store, b):
    rows, df = batch(store.spark, b)
    store.commit(b, {"t": store.stage("t", df.coalesce(1), b)})
    return {(d, k): v for d, k, v in rows}


def newest(store, documents=None):
    rows = store.newest("t", store.read("t", documents)).collect()
    return {(r["doc"], r["k"]): r["v"] for r in rows}


@pytest.mark.integration
@pytest.mark.parametrize("share_bytes", [1 << 30, 600])
def test_runs_stay_few_and_rows_whole(spark, share_bytes):
    store = RunStore(spark, workspace(spark, "t-store"), TABLES, fanout=3, share_bytes=share_bytes)
    want = {}
    for b in range(20):
        want |= add(store, b)
        store.compact()
        runs = store.manifest().runs["t"]
        levels = {r.level for r in runs}
        assert all(sum(r.level == lv for r in runs) < 3 for lv in levels) and len(runs) <= 2 * len(levels)
    assert newest(store) == want and len(want) == 36
    if share_bytes < 1000:  # the documents of a batch open their own shares only
        big = max(store.manifest().runs["t"], key=lambda r: r.of)
        assert big.of > 1
        one = spark.createDataFrame([("d3",)], "doc string")
        part = store.read("t", one)
        assert len(part.inputFiles()) < len(store.read("t").inputFiles())
        assert {k: v for k, v in newest(store, one).items() if k[0] == "d3"} == {
            k: v for k, v in want.items() if k[0] == "d3"
        }
    # folders of replaced runs go, but for those of the last merge
    left = set(folder.names(spark, f"{store.root}/runs"))
    assert left == {r.name for r in store.manifest().runs["t"]} | set(store.manifest().replaced)


@pytest.mark.integration
def test_crash_in_a_merge_leaves_the_old_manifest(spark, monkeypatch):
    store = RunStore(spark, workspace(spark, "t-crash"), TABLES, fanout=3)
    want = {}
    for b in range(3):
        want |= add(store, b)
    before = store.manifest()

    def stop(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(RunStore, "_put", stop)
        with pytest.raises(RuntimeError, match="driver lost"):
            store.compact()
    assert store.manifest() == before and newest(store) == want
    # a folder that no manifest names does not count, and the merge can be done again
    assert len(folder.names(spark, f"{store.root}/runs")) == 4
    assert store.compact() and len(store.manifest().runs["t"]) == 1 and newest(store) == want
    # a batch that was staged and not committed does not count either
    store.stage("t", batch(spark, 9)[1], 9)
    assert newest(store) == want and store.manifest().last_batch == 2


@pytest.mark.integration
def test_empty_store_and_empty_batch(spark):
    store = RunStore(spark, workspace(spark, "t-empty"), TABLES)
    assert newest(store) == {} and not store.compact()
    store.commit(0, {"t": store.stage("t", batch(spark, 0)[1].limit(0), 0)})
    assert newest(store) == {} and store.manifest().last_batch == 0


@pytest.mark.integration
def test_fifty_batches_equal_the_batch_result(spark):
    texts = [(f"d{i % 7}", "a", "", f"d{i % 7}_{i}.md", i, f"w{i} w{i % 5} common") for i in range(150)]
    again = [(*r[:5], r[5] + " again") for r in texts[::10]]
    root = workspace(spark, "t-fifty")
    rows = [*texts, *again]
    for b in range(50):  # 49 files of new variants, one of variants that arrive again
        part = texts[b * 3 : b * 3 + 3] if b < 50 else []
        part = part + (again if b == 49 else [])
        spark.createDataFrame(part, VARIANTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(VARIANTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    variant_stream.evaluate_stream(
        stream, f"{root}/out", f"{root}/cp", metrics=["word_overlap"], fanout=4
    ).awaitTermination()
    store = variant_stream.variant_store(spark, f"{root}/out", ["word_overlap"], fanout=4)
    now = store.manifest()
    assert now.last_batch == 49 and all(len(rs) <= 9 for rs in now.runs.values())
    newest_rows = {r[3]: r for r in rows}
    want = metrics.evaluate_pairs(spark.createDataFrame(list(newest_rows.values()), VARIANTS), ["word_overlap"])
    got = variant_stream.scores(spark, f"{root}/out", ["word_overlap"]).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


@pytest.mark.integration
def test_batch_that_runs_again(spark):
    """A batch that was scored and not committed is scored again; one that counts is left alone."""
    root = workspace(spark, "t-rerun")
    rows = [("d", "a", "", f"d_{i}.md", i, f"one w{i}") for i in range(3)]
    spark.createDataFrame(rows, VARIANTS).coalesce(1).write.parquet(f"{root}/in")

    def run(cp):
        stream = spark.readStream.schema(VARIANTS).parquet(f"{root}/in")
        variant_stream.evaluate_stream(stream, f"{root}/out", f"{root}/{cp}", metrics=["word_overlap"]).awaitTermination()
        got = variant_stream.scores(spark, f"{root}/out", ["word_overlap"])
        return sorted(map(tuple, got.collect()))

    first = run("cp1")
    manifest = folder.names(spark, f"{root}/out/manifest")
    # a new checkpoint hands out batch 0 once more
    assert run("cp2") == first and len(first) == 6
    assert folder.names(spark, f"{root}/out/manifest") == manifest
