"""Response chunks that arrive over time, assembled into page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscore.operators.convert import assemble_chunks

KEYS = ("doc_id", "page_no")


def stream_chunks(
    chunks: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Store arriving deltas under ``out``; ``assembled`` reads the texts.

    A batch only appends its own deltas: no state grows with the stream, a
    response may be spread over any number of batches however late they are, and a
    batch that runs again replaces its own folder.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        chunks.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def assembled(spark: SparkSession, out: str) -> DataFrame:
    """Page texts of all deltas stored so far."""
    return assemble_chunks(spark.read.parquet(out).drop("batch_id"), KEYS)
