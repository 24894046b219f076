"""New variants scored as they arrive, against those already stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscore.functions.normalize import maybe_strip
from folioscore.operators.metrics import METRICS, column_of, evaluate_against
from folioscore.schemas import VARIANTS
from folioscore.session import spread
from folioscore.sources import folder
from folioscore.streaming.store import BATCH, RunStore, Table

PAIR = ("filestem", "file1", "file2")


def variant_store(
    spark: SparkSession, out: str, metrics: Sequence[str] = METRICS, **options: int
) -> RunStore:
    """The store of a stream: ``variants`` and their ``scores``; options as of ``RunStore``."""
    columns = "".join(f", {column_of(m)} double" for m in metrics)
    return RunStore(
        spark,
        out,
        {
            "variants": Table(VARIANTS, ("filestem", "file")),
            "scores": Table(
                f"filestem string, file1 string, ord1 int, file2 string, ord2 int{columns}", PAIR
            ),
        },
        **options,
    )


def evaluate_stream(
    variants: DataFrame,
    out: str,
    checkpoint: str,
    strip: bool = False,
    metrics: Sequence[str] = METRICS,
    trigger: dict | None = None,
    **options: int,
) -> StreamingQuery:
    """Each batch scores its variants among themselves and against the stored
    ones of the same documents, then joins the store.

    Variants and scores are runs of a ``RunStore`` (``options`` are its own), and a batch's runs
    count from one manifest on, so a batch that runs again after a failure is scored anew if it did
    not count yet and left out if it did. Of a variant that arrives again, the newest text counts: it
    is scored anew, and ``scores`` leaves out what older texts of it had. A batch reads the shares of
    its documents only, and a semi-join keeps only the variants of its documents before any tokenising.
    """
    schema = tuple(c.split()[0] for c in VARIANTS.split(", "))

    def score(batch: DataFrame, batch_id: int) -> None:
        store = variant_store(batch.sparkSession, out, metrics, **options)
        if store.manifest().last_batch >= batch_id:
            return
        newest = F.max_by(F.struct("parser", "model", "ord", "text"), F.struct("ord", "text"))
        arrived = (
            batch.withColumn("text", maybe_strip("text", strip))
            .groupBy("filestem", "file")
            .agg(newest.alias("_n"))
            .select("filestem", "_n.parser", "_n.model", "file", "_n.ord", "_n.text")
        )
        staged = {"variants": store.stage("variants", arrived.select(*schema), batch_id)}
        fresh = spread(store.read_run("variants", staged["variants"]).drop(BATCH))
        touched = fresh.select("filestem").distinct()
        stored = (
            store.read("variants", touched)
            .join(touched, "filestem", "left_semi")
            .join(fresh.select("filestem", "file"), ["filestem", "file"], "left_anti")
        )
        scored = evaluate_against(fresh, store.newest("variants", stored).drop(BATCH), metrics)
        staged["scores"] = store.stage("scores", scored, batch_id)
        store.commit(batch_id, staged)
        store.compact()

    return (
        variants.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def scores(spark: SparkSession, out: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Scores of the newest texts: of each pair the ones of the last batch."""
    if not folder.names(spark, f"{out}/manifest"):
        raise ValueError(f"No scores under {out}")
    store = variant_store(spark, out, metrics)
    return store.newest("scores", store.read("scores")).drop(BATCH)
