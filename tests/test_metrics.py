"""Pairs, metrics and their other shapes."""

import random

import pytest
from pyspark.sql import functions as F

from folioscore.operators import metrics, reshape
from folioscore.operators.pairs import variant_pairs
from folioscore.plans import tables
from folioscore.plans.evaluate import evaluate
from folioscore.schemas import VARIANTS
from tests import brute

pytestmark = pytest.mark.unit


def variants_of(spark, groups):
    rows = [
        (g, f"p{i}", None, f"{g}_p{i:03d}.md", i, t)
        for g, texts in groups.items()
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, VARIANTS)


def pair_of(spark, a, b, names=metrics.METRICS):
    wide = metrics.evaluate_pairs(variants_of(spark, {"d": [a, b]}), names)
    return wide.where("ord1 = 0 and ord2 = 1").first()


def test_golden_pairs(spark):
    row = pair_of(
        spark,
        "This is a test sentence for similarity comparison",
        "This is a test phrase for similarity comparison",
    )
    assert round(row["cosine"], 2) == 0.75
    assert row["cosine"] == pytest.approx(0.7523197619890013, abs=1e-12)
    assert pair_of(spark, "", "This is not empty")["cosine"] == 0.0
    row = pair_of(spark, "apple banana cherry date", "apple banana fig grape")
    assert row["word_overlap"] == 2 / 6
    assert pair_of(spark, "kitten", "sitting")["levenshtein"] == pytest.approx(8 / 13)
    row = pair_of(
        spark,
        "The quick brown fox jumps over the lazy dog",
        "The fast brown fox jumps over the lazy dog",
    )
    assert row["rouge_1"] == pytest.approx(8 / 9, abs=1e-7)
    assert row["rouge_2"] == pytest.approx(6 / 8, abs=1e-7)
    assert 0 <= row["rouge_l"] <= 1


def test_empty_sides(spark):
    row = pair_of(spark, "", "")
    assert row["levenshtein"] == 1.0
    assert [row[c] for c in ("word_overlap", "cosine", "rouge_1", "rouge_2", "rouge_l")] == [0.0] * 5
    row = pair_of(spark, "...", "words here")
    assert [row[c] for c in ("rouge_1", "rouge_2", "rouge_l")] == [0.0] * 3
    assert pair_of(spark, "word", "word")["rouge_2"] == 0.0


def test_against_brute_force_with_one_large_group(spark):
    """A third of all variants in one document, random texts."""
    rng = random.Random(5)
    words = "the a fox dog runs. jumps over Lazy x é naïve end. two_2".split()

    def text():
        return " ".join(rng.choices(words, k=rng.randint(0, 25)))

    groups = {"hot": [text() for _ in range(20)]}
    groups.update({f"d{i}": [text() for _ in range(4)] for i in range(10)})
    df = variants_of(spark, groups)
    got = metrics.evaluate_pairs(df, [*metrics.METRICS, metrics.UNION_ROUGE_L]).collect()
    assert len(got) == 20 * 21 // 2 + 10 * 10
    for row in got:
        a = groups[row["filestem"]][row["ord1"]]
        b = groups[row["filestem"]][row["ord2"]]
        for name, want in brute.scores(a, b).items():
            assert row[name] == pytest.approx(want, abs=1e-9), (name, a, b)


def test_invariants_on_given_texts(spark, tiny):
    df = tables.variants(spark, tiny)
    n = {r[0]: r[1] for r in df.groupBy("filestem").count().collect()}
    wide = metrics.evaluate_pairs(df).collect()
    assert len(wide) == sum(k * (k + 1) // 2 for k in n.values())
    for r in wide:
        values = [r[metrics.column_of(m)] for m in metrics.METRICS]
        assert all(-1e-12 <= v <= 1 + 1e-12 for v in values)
        if r["file1"] == r["file2"]:
            assert all(v == pytest.approx(1, abs=1e-8) for v in values)


def test_pair_plan_shuffles_once_and_never_crosses(spark, tiny):
    df = metrics.evaluate_pairs(tables.variants(spark, tiny))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and "ReusedExchange" in final
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    shuffles = [
        line
        for line in final.splitlines()
        if "Exchange hashpartitioning" in line and "ReusedExchange" not in line
    ]
    assert len(shuffles) == 1


def test_large_document_is_split_over_tasks(spark):
    """A third of all variants in one document: AQE splits it on both sides."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "two", "three", "four", "five"], k=200)) for _ in range(60)]
    groups = {"hot": texts, **{f"d{i}": texts[:2] for i in range(60)}}
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = metrics.evaluate_pairs(
            variants_of(spark, groups).repartition(8), ["word_overlap", "levenshtein"]
        )
        rows = reshape.metrics_long(df, ["word_overlap", "levenshtein"])
        ranked = rows.groupBy("filestem", "Metric").count()
        counts = {(r[0], r[1]): r[2] for r in ranked.collect()}
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
    assert counts[("hot", "levenshtein")] == 60 * 61 // 2
    assert all(n == 3 for (stem, _), n in counts.items() if stem != "hot")


def test_twenty_variants_of_one_document(spark):
    turns = [(7, t, "user", f"turn {t} of the long talk " + "word " * t) for t in range(20)]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    variants = tables.variants_of(talk)
    assert variants.select("file").distinct().count() == 20
    wide = metrics.evaluate_pairs(variants, ["word_overlap"])
    assert wide.count() == 210
    matrix = reshape.similarity_matrix(reshape.metrics_long(wide, ["word_overlap"]))
    rows = {r["File"]: r for r in matrix.collect()}
    order = [r["file"] for r in variants.orderBy("ord").collect()]
    assert len(rows) == 20 and all(r["columns"] == order for r in rows.values())
    assert all(rows[a]["values"][j] == rows[b]["values"][i] for i, a in enumerate(order) for j, b in enumerate(order))
    assert "Window" not in matrix._jdf.queryExecution().executedPlan().toString()
    checked = variants.where("ord = 3").select("filestem", "file")
    some = metrics.evaluate_checked(variants, checked, ["word_overlap"])
    assert some.count() == 19
    both = ["file1", "file2", "word_overlap"]
    assert some.select(both).exceptAll(wide.select(both)).isEmpty()


def test_stats_and_differences(spark):
    df = variants_of(spark, {"d": ["a b c", "b c d e"]})
    row = metrics.word_stats(df).where("ord1 < ord2").first()
    assert [row[c] for c in ("words_1", "words_2", "common", "only_1", "only_2")] == [3, 4, 2, 1, 2]
    row = metrics.word_differences(df).where("ord1 < ord2").first()
    assert (row["only_in_1"], row["only_in_2"]) == (["a"], ["d", "e"])


def test_pairs_against_stored_equal_pairs_together(spark):
    df = variants_of(spark, {"d": ["a b", "b c", "c d", "d e"], "e": ["x", "x y"]})
    names = ["word_overlap"]
    whole = metrics.evaluate_pairs(df, names)
    old = df.where("ord % 2 = 0")
    new = df.where("ord % 2 = 1")
    parts = metrics.evaluate_pairs(old, names).union(metrics.evaluate_against(new, old, names))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_long_matrix_report_rank(spark):
    df = variants_of(spark, {"d": ["a b c", "b c d", "z"]})
    wide = metrics.evaluate_pairs(df, with_word_stats=True)
    rows = reshape.metrics_long(wide)
    ordered = reshape.in_report_order(rows).collect()
    assert len(ordered) == 36
    assert [r["Metric"] for r in ordered[::6]] == list(metrics.METRICS)
    matrix = reshape.similarity_matrix(rows).where("Metric = 'word_overlap'").orderBy("File")
    got = matrix.collect()
    assert [r["values"] for r in got] == [[1.0, 0.5, 0.0], [0.5, 1.0, 0.0], [0.0, 0.0, 1.0]]
    assert {tuple(r["columns"]) for r in got} == {("d_p000.md", "d_p001.md", "d_p002.md")}
    report = reshape.evaluation_report(wide).where("file1 <> file2").orderBy("file1", "file2").first()
    assert report["title"] == "Evaluation Results: p000 vs p001"
    assert "Word Overlap Ratio: 0.5000" in report["report"]
    assert "Unique to p000: 1" in report["report"]
    checked = spark.createDataFrame([("d", "d_p001.md")], "filestem string, file string")
    best = (
        reshape.rank_against_checked(rows, checked)
        .where("Metric = 'word_overlap'")
        .orderBy("rank")
        .collect()
    )
    assert [(r["file"], r["rank"]) for r in best] == [("d_p000.md", 1), ("d_p002.md", 2)]


def test_missing_matrix_cells_are_zero(spark):
    rows = spark.createDataFrame(
        [("d", "m", "a", "b", 0.5, 0, 1), ("d", "m", "a", "c", 0.3, 0, 2), ("d", "m", "b", "c", 0.7, 1, 2)],
        "filestem string, Metric string, File1 string, File2 string, Value double, ord1 int, ord2 int",
    )
    got = reshape.similarity_matrix(rows).orderBy("File").collect()
    assert {tuple(r["columns"]) for r in got} == {("a", "b", "c")}
    assert [r["values"] for r in got] == [[0.0, 0.5, 0.3], [0.5, 0.0, 0.7], [0.3, 0.7, 0.0]]


def test_two_models_of_one_parser_have_their_own_columns(spark):
    rows = [("d", "openai", m, f"d_openai_{m}.md", 3, t) for m, t in [("a", "x y"), ("b", "x z")]]
    rows.append(("d", "mistral", "m", "d_mistral_m.md", 2, "x"))
    rows_long = reshape.metrics_long(
        metrics.evaluate_pairs(spark.createDataFrame(rows, VARIANTS), ["word_overlap"]), ["word_overlap"]
    )
    first = reshape.similarity_matrix(rows_long).where("File = 'd_openai_b.md'").first()
    assert first["columns"] == ["d_mistral_m.md", "d_openai_a.md", "d_openai_b.md"]
    assert first["values"] == [0.5, pytest.approx(1 / 3), 1.0]


def test_modes(spark):
    df = variants_of(spark, {"d": ["# **a** b", "a b"]})
    by_mode = {
        s: evaluate(df, s, ["word_overlap"]).where("ord1 < ord2").first() for s in (True, False)
    }
    assert by_mode[True]["word_overlap"] == 1.0 and by_mode[True]["mode"] == "stripped"
    assert by_mode[False]["word_overlap"] == 0.25 and by_mode[False]["mode"] == "with Markdown"


def test_pairs_carry_columns(spark):
    df = variants_of(spark, {"d": ["a", "b"]})
    got = variant_pairs(df, ["text"]).orderBy("ord1", "ord2").select("text1", "text2").collect()
    assert [tuple(r) for r in got] == [("a", "a"), ("a", "b"), ("b", "b")]
    assert variant_pairs(df).where(F.col("ord1") > F.col("ord2")).isEmpty()
