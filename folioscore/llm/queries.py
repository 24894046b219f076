"""The operators of this folder as queries over the given tables, with SQL where SQL can say it.

A query reads whole tables, calls its operator and derives the result's columns from the
operator's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.llm import (
    alignment,
    chat,
    decontaminate,
    hamming_topk,
    line_dedup,
    mixing,
    order_minhash,
    packing,
    periodic,
    ppm,
    quality,
    toxicity,
    url_filter,
)

#: (verdict, host, path)
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark, d):
    """Ten nearest sign codes of every vector whose id is divisible by 20."""
    items = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), hamming_topk.sign_code("embedding").alias("code")
    )
    return hamming_topk.hamming_topk(items, items.filter("id % 20 = 0")).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "distance"
    )


def op2_mix_sources(spark, d):
    mixed = mixing.mix_sources(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs))
    return scored.select("doc_id", "score", "accepted")


def op4_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_order_minhash(spark, d):
    return order_minhash.classify(table(spark, d, "documents").select("doc_id", "text"))


def _remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (a null id as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op6_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, d, "labels"), _remainder(3) != 1)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (_remainder(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_lm_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ppm.score_documents(docs, _remainder(10) != 0).select(
        "doc_id",
        (_remainder(10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op8_chat_format(spark, d):
    columns = ("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, d, "conversations").select(*columns).unionByName(extra)
    records = chat.records_of(rows)
    done = chat.format_turns(chat.canonical_turns(records, "record")).select(
        "conv_id",
        "layout",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("read"),
        chat.loss_text(F.col("segments")).alias("loss"),
    )
    lines = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_decontaminate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, d, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_url_filter(spark, d):
    outcomes = table(spark, d, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"),
    )
    return url_filter.filter_urls(table(spark, d, "pages"), outcomes, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "host_labels", "bad_mean", "bad_bound"
    )


def _made_periodic(docs: DataFrame) -> DataFrame:
    """A tenth of the texts get a periodic end: from word ``a`` on, words repeat with period ``p``."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = docs.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when(h % 10 == 0, words))
    n = F.size("_w")
    a = (F.col("_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    repeated = F.array_repeat(F.slice("_w", a + 1, p), F.ceil((n - a) / p).cast("int"))
    made = F.slice(F.concat(F.slice("_w", F.lit(1), a), F.flatten(repeated)), F.lit(1), n)
    text = F.when(n > 0, F.array_join(made, " ")).otherwise(F.col("text"))
    return cut.withColumn("text", text).drop("_g", "_w")


def op11_periodic_runs(spark, d):
    docs = _made_periodic(table(spark, d, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs)
    ranked = F.transform(
        "runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("at"), r["period"].alias("p"))
    )
    longest = found.withColumn("_longest", F.array_max(ranked))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("_longest.length"), F.col("_longest.p")
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_longest.at").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pack_documents(spark, d):
    packed = packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))
    return packed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )


def op13_align_tokenizers(spark, d):
    aligned = alignment.align(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
        "links",
    )
    return alignment.score_links(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def pipeline(spark, d):
    import corpus_pipeline  # beside the package, not in it

    return corpus_pipeline.run(spark, d)


QUERIES = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_order_minhash": op5_order_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_lm_score": op7_lm_score,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pack_documents": op12_pack_documents,
    "op13_align_tokenizers": op13_align_tokenizers,
    "pipeline": pipeline,
}
