"""Streams in several batches give what a batch job gives."""

import pytest
from pyspark.sql import functions as F

from folioscore.operators import convert, metrics
from folioscore.plans import tables
from folioscore.schemas import CHUNKS, VARIANTS
from folioscore.session import shared_root, workspace
from folioscore.streaming import chunks as chunk_stream
from folioscore.streaming import variants as variant_stream

pytestmark = pytest.mark.integration
EACH_FILE = {"availableNow": True}


def arriving(spark, df, schema, path, parts):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chunks_in_batches(spark, tiny):
    chunks = tables.chunks(spark, tiny)
    root = workspace(spark, "t-chunks")
    stream = arriving(spark, chunks, CHUNKS, f"{root}/in", 4)
    chunk_stream.stream_chunks(stream, f"{root}/out", f"{root}/cp", trigger=EACH_FILE).awaitTermination()
    got = chunk_stream.assembled(spark, f"{root}/out")
    want = convert.assemble_chunks(chunks)
    assert spark.read.parquet(f"{root}/out").select("batch_id").distinct().count() == 4
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_variants_in_batches_and_a_repeated_batch(spark, tiny):
    names = ["word_overlap", "rouge-1"]
    variants = tables.variants(spark, tiny)
    root = workspace(spark, "t-variants")
    stream = arriving(spark, variants, VARIANTS, f"{root}/in", 3)
    variant_stream.evaluate_stream(
        stream, f"{root}/out", f"{root}/cp", metrics=names, trigger=EACH_FILE
    ).awaitTermination()
    got = variant_stream.scores(spark, f"{root}/out", names)
    want = metrics.evaluate_pairs(variants, names)
    assert got.count() == want.count()
    keep = ["filestem", "file1", "file2", *[F.round(metrics.column_of(m), 9) for m in names]]
    assert got.select(*keep).exceptAll(want.select(*keep)).isEmpty()


def test_newest_text_of_a_variant_counts(spark):
    first = [("d", "a", "", "d_a.md", 0, "one two"), ("d", "b", "", "d_b.md", 1, "one two")]
    second = [("d", "b", "", "d_b.md", 1, "three four"), ("d", "c", "", "d_c.md", 2, "three two")]
    root = workspace(spark, "t-again")
    for rows in (first, second):
        spark.createDataFrame(rows, VARIANTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(VARIANTS).parquet(f"{root}/in")
        variant_stream.evaluate_stream(stream, f"{root}/out", f"{root}/cp", metrics=["word_overlap"]).awaitTermination()
    got = variant_stream.scores(spark, f"{root}/out", ["word_overlap"])
    newest = spark.createDataFrame([first[0], *second], VARIANTS)
    want = metrics.evaluate_pairs(newest, ["word_overlap"]).select(*got.columns)
    assert got.count() == 6 and got.exceptAll(want).isEmpty()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
