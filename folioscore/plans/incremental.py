"""Evaluation of a folder that changes: only documents whose files changed are scored again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.functions.normalize import mode_label
from folioscore.operators.metrics import METRICS, column_of
from folioscore.plans.evaluate import evaluate
from folioscore.sources.files import DEFAULT_PARSERS
from folioscore.sources.markdown import scan_files
from folioscore.streaming.store import BATCH, RunStore, Table

#: Changed stems up to this number are read by name; more by a join over the folder.
NAMED_STEMS = 1000


@dataclass(frozen=True)
class Changes:
    """How many stems a run scored again, and how many it found gone."""

    scored: int
    gone: int


def _store(spark: SparkSession, out: str, strip: bool, metrics: Sequence[str], **options: int) -> RunStore:
    columns = "".join(f", {column_of(m)} double" for m in metrics)
    return RunStore(
        spark,
        f"{out.rstrip('/')}/{mode_label(strip).replace(' ', '-')}",
        {
            "stems": Table("filestem string, digest string, present boolean", ("filestem",)),
            "scores": Table(
                f"filestem string, file1 string, ord1 int, file2 string, ord2 int{columns}",
                ("filestem", "file1", "file2"),
            ),
        },
        **options,
    )


def stem_digests(variants: DataFrame) -> DataFrame:
    """``filestem, digest``: of the names and texts of all files of a stem."""
    file = F.concat_ws("\u0000", "file", F.col("ord").cast("string"), F.sha2("text", 256))
    # one shuffle of digests; texts stay where they were read
    return variants.select("filestem", file.alias("_f")).groupBy("filestem").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_set("_f")), "\u0001"), 256).alias("digest")
    )


def evaluate_changed(
    spark: SparkSession,
    path: str,
    out: str,
    parsers: Sequence[str] = DEFAULT_PARSERS,
    strip: bool = True,
    metrics: Sequence[str] = METRICS,
    **options: int,
) -> Changes:
    """Bring the scores under ``out`` up to date with a folder of Markdown files.

    A manifest keeps a digest per stem of all its files, names and texts. Stems whose digest is new are
    scored; those that have no file any more are marked gone. Where nothing changed, no pair is formed and
    nothing is written. ``evaluated`` reads the scores; both strip modes have their own.
    """
    store = _store(spark, out, strip, metrics, **options)
    variants = scan_files(spark, path, parsers)
    known = store.newest("stems", store.read("stems")).where("present")
    now = stem_digests(variants).select("filestem", F.col("digest").alias("_now"))
    compared = now.join(known.select("filestem", "digest"), "filestem", "full").where(
        ~F.col("_now").eqNullSafe(F.col("digest"))
    )
    stems = compared.select("filestem", F.col("_now").alias("digest"), F.col("_now").isNotNull().alias("present"))
    batch = store.manifest().last_batch + 1
    staged = {"stems": store.stage("stems", stems, batch)}
    changed = store.read_run("stems", staged["stems"])
    counts = {r["present"]: r["n"] for r in changed.groupBy("present").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Changes(0, 0)
    if counts.get(True):
        scored = changed.where("present").select("filestem")
        if counts[True] <= NAMED_STEMS:
            wanted = variants.where(F.col("filestem").isin([r[0] for r in scored.collect()]))
        else:
            wanted = variants.join(scored, "filestem", "left_semi")
        staged["scores"] = store.stage("scores", evaluate(wanted, strip, metrics).drop("mode"), batch)
    store.commit(batch, staged)
    store.compact()
    return Changes(counts.get(True, 0), counts.get(False, 0))


def evaluated(
    spark: SparkSession, out: str, strip: bool = True, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Wide scores of the stems that are there, each by the run that scored it last."""
    store = _store(spark, out, strip, metrics)
    last = store.newest("stems", store.read("stems")).where("present").select("filestem", BATCH)
    scores = store.newest("scores", store.read("scores"))
    return scores.join(last, ["filestem", BATCH], "left_semi").drop(BATCH)
