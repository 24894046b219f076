"""The pipeline's stages, one by one and together."""

import corpus_pipeline
from folioscore.llm import decontaminate, line_dedup, mixing, order_minhash
from folioscore.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, tiny).cache()
        assert kept.columns == COLUMNS, name
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = kept.collect()
        assert rows and {r["doc_id"] for r in rows} <= set(before), name
        if name == "line dedup":  # lines go; a document goes only with its last line
            shorter = [r for r in rows if r["text"] != before[r["doc_id"]]]
            assert shorter and all(len(r["text"]) < len(before[r["doc_id"]]) for r in shorter), name
        else:
            assert len(rows) < len(before), name
        docs = kept
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    # nothing that a stage removes is left
    assert not any(line_dedup.drop_lines(t, None, 20)[1] for _, t in texts)
    assert order_minhash.classify(docs).filter("doc_id <> class_id").isEmpty()
    benchmark = spark.read.parquet(f"{tiny}/benchmark.parquet")
    assert decontaminate.contamination(docs, benchmark).filter("contaminated").isEmpty()
    name, stage = corpus_pipeline.STAGES[-1]
    mixed = {r["doc_id"]: r["repeats"] for r in stage(spark, docs, tiny).collect()}
    want = {r["doc_id"]: r["epochs"] + r["selected"] for r in mixing.mix_sources(docs).collect()}
    assert mixed == {d: n for d, n in want.items() if n} and mixed


def test_run_is_the_stages_in_turn(spark, tiny):
    rows = corpus_pipeline.run(spark, tiny).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    again = QUERIES["pipeline"](spark, tiny).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_documents(spark, tiny):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for docs_in in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs_in, tiny).collect()
