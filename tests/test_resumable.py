"""Conversion with a ledger: killed jobs go on, finished units are sent once, policies by row."""

import os
import time

import pytest

from folioscore.operators import convert

pytestmark = pytest.mark.integration
SCHEMA = "doc_id string, page_no int, parser string, model string, page_text string, note int"


def units(spark, n=24, parser="openai"):
    rows = [(f"d{i % 6}", i, parser, "m", f"text {i}", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def calls(folder):
    """How often each text was sent."""
    out = {}
    for name in os.listdir(folder):
        text = name.split("-")[0]
        out[text] = out.get(text, 0) + 1
    return out


def converter(log, kill=None, busy=()):
    def fn(text, attempt):
        with open(f"{log}/{text}-{attempt}-{time.time_ns()}", "w"):
            pass
        if text == kill and not os.path.exists(f"{log}/../alive"):
            time.sleep(1)
            os._exit(1)  # the worker is gone, with all that it has not written
        if text in busy and attempt < 3:
            raise TimeoutError("busy")
        if text == "text 3":
            raise ValueError("unreadable")
        return text.upper()

    return fn


def quick(parser):
    how = convert.retry_for(parser, (TimeoutError,))
    return convert.Retry(transient=how.transient, attempts=how.attempts, sleep=lambda s: None)


def test_killed_job_goes_on(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()
    fn = converter(str(log), kill="text 17")
    with pytest.raises(Exception):
        convert.convert_resumable(units(spark), fn, ledger, window=2, flush=1)
    before = calls(log)
    assert 1 < len(before) < 25
    saved = {r["page_no"] for r in convert._read_ledger(spark, ledger).collect()}
    (tmp_path / "alive").write_text("")
    got = convert.convert_resumable(units(spark), fn, ledger, window=2, flush=1).collect()
    after = calls(log)
    # what was in the ledger was not sent again; the rest was
    assert all(after[f"text {i}"] == 1 for i in saved) and len(after) == 24
    assert {r["page_no"]: r["markdown"] for r in got} == {i: None if i == 3 else f"TEXT {i}" for i in range(24)}
    assert all(r["note"] == r["page_no"] and r["parser"] == "openai" and r["model"] == "m" for r in got)
    # a third run sends nothing at all; a changed text or model is a new request
    convert.convert_resumable(units(spark), fn, ledger, window=2).collect()
    assert calls(log) == after
    changed = units(spark).withColumn("model", convert.F.when(convert.F.col("page_no") < 2, "n").otherwise("m"))
    assert convert.convert_resumable(changed, fn, ledger).count() == 24
    assert sum(calls(log).values()) == sum(after.values()) + 2


def test_policies_by_row_and_unfinished_retries(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()
    fn = converter(str(log), busy=("text 1", "text 2"))
    both = units(spark, 4, "openai").unionByName(
        units(spark, 4, "googleai").withColumn("page_text", convert.F.concat(convert.F.col("page_text"), convert.F.lit("")))
    )
    got = {(r["parser"], r["page_no"]): r for r in convert.convert_resumable(both, fn, ledger, policy=quick).collect()}
    assert got["googleai", 1]["markdown"] == "TEXT 1" and got["googleai", 1]["attempts"] == 3
    assert got["openai", 1]["status"] == "error" and got["openai", 1]["attempts"] == 1
    assert {got[p, 3]["error"] for p in ("openai", "googleai")} == {"unreadable"}


def test_transient_failures_are_sent_again_by_a_later_run(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()
    policy = lambda parser: convert.Retry((TimeoutError,), attempts=1, sleep=lambda s: None)
    busy = convert.convert_resumable(units(spark, 4), converter(str(log), busy=("text 2",)), ledger, policy=policy)
    assert {r["page_no"]: r["status"] for r in busy.collect()} == {0: "ok", 1: "ok", 2: "error", 3: "error"}
    later = convert.convert_resumable(units(spark, 4), converter(str(log)), ledger, policy=policy)
    assert {r["page_no"]: r["status"] for r in later.collect()} == {0: "ok", 1: "ok", 2: "ok", 3: "error"}
    assert calls(log) == {"text 0": 1, "text 1": 1, "text 2": 2, "text 3": 1}


def test_waits_overlap(spark, tmp_path):
    def slow(text, attempt):
        time.sleep(0.5)
        return text

    rows = units(spark, 16).coalesce(1)
    start = time.perf_counter()
    assert convert.convert_resumable(rows, slow, str(tmp_path / "l"), window=16).count() == 16
    assert time.perf_counter() - start < 6
    assert convert.convert_resumable(rows.limit(0), slow, str(tmp_path / "e")).collect() == []
