"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.functions import normalize, tokens
from folioscore.operators import answers, convert, layout, markup, metrics, registry, render, reshape
from folioscore.operators.pairs import tiled_pairs, variant_pairs
from folioscore.plans import tables
from folioscore.plans.evaluate import evaluate
from folioscore.schemas import METRIC_ROWS
from folioscore.session import spread, workspace
from folioscore.sources import files, markdown, naming, sinks
from folioscore.streaming import chunks as chunk_stream
from folioscore.streaming import responses as response_stream
from folioscore.streaming import variants as variant_stream

PAIR = ("filestem", "file1", "file2")
SYSTEM_TEXT = "Convert the document to Markdown."


def _rounded(df: DataFrame, names: Sequence[str], places: int = 6) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, places))
    return df


def _digest(words: Column) -> Column:
    return F.md5(F.array_join(F.sort_array(words), " "))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return spread(tables.variants(spark, d))


def _metric(name: str):
    column = metrics.column_of(name)

    def query(spark: SparkSession, d: str) -> DataFrame:
        wide = metrics.evaluate_pairs(_variants(spark, d), [name])
        return _rounded(wide, [column]).select(*PAIR, column)

    return query


def pairs(spark, d):
    return variant_pairs(_variants(spark, d)).select(*PAIR)


def pairs_in_tiles(spark, d):
    """The same pairs, conversations of more than three turns parted into tiles."""
    return tiled_pairs(_variants(spark, d), tile=3).select(*PAIR)


def word_stats(spark, d):
    return metrics.word_stats(_variants(spark, d)).drop("ord1", "ord2")


def word_differences(spark, d):
    return metrics.word_differences(_variants(spark, d)).select(
        *PAIR,
        F.array_join("only_in_1", " ").alias("only_in_1"),
        F.array_join("only_in_2", " ").alias("only_in_2"),
    )


def levenshtein_distance(spark, d):
    return metrics.levenshtein_distance(_variants(spark, d)).drop("ord1", "ord2")


def evaluate_pairs(spark, d):
    wide = metrics.evaluate_pairs(_variants(spark, d))
    names = [metrics.column_of(m) for m in metrics.METRICS]
    return _rounded(wide, names).select(*PAIR, *names)


def evaluate_modes(spark, d):
    """Word overlap of dressed texts, stripped and as they are."""
    dressed = spread(tables.dressed_variants(spark, d))
    both = [evaluate(dressed, strip, ["word_overlap"]) for strip in (True, False)]
    return _rounded(both[0].unionByName(both[1]), ["word_overlap"]).select(
        "mode", *PAIR, "word_overlap"
    )


def evaluation_report(spark, d):
    """Report texts; scores and word counts come from one pass over the pairs."""
    variants = _variants(spark, d)
    return reshape.evaluation_report(
        metrics.evaluate_pairs(variants, with_word_stats=True)
    )


def _long(spark: SparkSession, d: str) -> DataFrame:
    wide = metrics.evaluate_pairs(_variants(spark, d))
    return _rounded(reshape.metrics_long(wide), ["Value"])


def metrics_long(spark, d):
    return _long(spark, d).select("filestem", "metric_pos", "Metric", "File1", "File2", "Value")


def similarity_matrix(spark, d):
    """Matrix rows; the values, in millionths, joined in the order of the files."""
    matrix = reshape.similarity_matrix(_long(spark, d))
    millionths = F.transform("values", lambda v: F.round(v * 1e6).cast("long").cast("string"))
    return matrix.select(
        "filestem",
        "Metric",
        "File",
        F.array_join("columns", " ").alias("columns"),
        F.array_join(millionths, " ").alias("values"),
    )


def rank_against_checked(spark, d):
    """The first variant of each document is the checked one."""
    scored = metrics.evaluate_checked(_variants(spark, d))
    return reshape.rank_against_checked(_rounded(reshape.metrics_long(scored), ["Value"]))


def metrics_csv(spark, d):
    """Metric rows saved as CSV and read back."""
    out = workspace(spark, "metrics")
    sinks.write_metrics(_long(spark, d).select("Metric", "File1", "File2", "Value"), out)
    return spark.read.schema(METRIC_ROWS).option("header", True).csv(out)


def saved_markdown(spark, d):
    """Variants saved, dressed ones saved over them, and the newest read back."""
    out = workspace(spark, "markdown")
    for saved in (_variants(spark, d), spread(tables.dressed_variants(spark, d))):
        sinks.write_markdown(saved.withColumnRenamed("text", "markdown"), out)
    return sinks.read_saved(spark, out)


def _variant_files(spark: SparkSession, d: str) -> DataFrame:
    """Variants saved as Markdown files and scanned back."""
    out = workspace(spark, "files")
    markdown.save_files(_variants(spark, d).select("file", "text"), out)
    return markdown.scan_files(spark, out, registry.PARSER_NAMES)


def variant_files(spark, d):
    scanned = _variant_files(spark, d)
    return scanned.select("filestem", "parser", "file", "ord", F.md5("text").alias("digest"))


def evaluate_files(spark, d):
    """Metric rows of variants that went through files."""
    rows = reshape.metrics_long(evaluate(spread(_variant_files(spark, d)), strip=False))
    return _rounded(rows, ["Value"]).select("filestem", "Metric", "File1", "File2", "Value")


def strip_markdown(spark, d):
    docs = spread(tables.dressed_documents(spark, d))
    return docs.select("doc_id", normalize.strip_markdown("text").alias("text"))


def strip_plain_documents(spark, d):
    docs = tables.text_table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", normalize.strip_markdown("text").alias("text"))


def truncate_for_rouge(spark, d):
    cut = normalize.truncate_for_rouge("text")
    return (
        tables.table(spark, d, "documents")
        .select("doc_id", cut.alias("cut"))
        .select("doc_id", F.length("cut").alias("chars"), F.md5("cut").alias("digest"))
    )


def _document_texts(spark: SparkSession, d: str) -> DataFrame:
    return tables.text_table(spark, d, "documents", "doc_id", "text")


def tfidf_terms(spark, d):
    counted = _document_texts(spark, d).select(
        "doc_id", tokens.term_counts(tokens.terms(F.col("text"))).alias("counts")
    )
    entry = F.transform(
        F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    )
    return counted.select(
        "doc_id",
        F.size("counts").alias("terms"),
        tokens.square_sum(F.col("counts")).alias("square_sum"),
        F.md5(F.array_join(entry, " ")).alias("digest"),
    )


def overlap_words(spark, d):
    words = _document_texts(spark, d).select(
        "doc_id", tokens.overlap_words(F.col("text")).alias("words")
    )
    return words.select("doc_id", F.size("words").alias("words"), _digest(F.col("words")).alias("digest"))


def rouge_ngrams(spark, d):
    sentence = F.col("sentence")
    grams = (
        _document_texts(spark, d)
        .select("doc_id", tokens.rouge_text(F.col("text")).alias("sentence"))
        .select(
            "doc_id",
            tokens.rouge_words(sentence).alias("w"),
            tokens.rouge_unigrams(sentence).alias("u"),
            tokens.rouge_bigrams(sentence).alias("b"),
        )
    )
    return grams.select(
        "doc_id",
        F.size("w").alias("words"),
        F.size("u").alias("unigrams"),
        F.size("b").alias("bigrams"),
        F.md5(F.array_join("w", " ")).alias("digest_words"),
        _digest(F.col("b")).alias("digest_bigrams"),
    )


def find_variants(spark, d):
    listing = tables.variants(spark, d).select("filestem", "file")
    return files.match_variants(listing, F.col("filestem")).select(
        "filestem", "ord", "parser", "file"
    )


def output_names(spark, d):
    """Name of each document's result for the parser and model of its job."""
    named = tables.requested_inputs(spark, d).join(tables.jobs(spark, d), "doc_id")
    return named.select(
        "doc_id",
        naming.output_name(F.col("path"), F.col("parser"), F.col("model")).alias("file"),
    )


def variant_labels(spark, d):
    return tables.variants(spark, d).select(
        "file", naming.variant_label(F.col("file")).alias("label")
    )


def axis_labels(spark, d):
    path = F.concat(F.lit("output/"), F.col("file"))
    return tables.variants(spark, d).select("file", naming.axis_label(path).alias("label"))


def validate_inputs(spark, d):
    return files.validate_inputs(tables.requested_inputs(spark, d), tables.input_listing(spark, d))


def encode_payload(spark, d):
    content = F.encode("html", "UTF-8")
    return tables.table(spark, d, "pages").select(
        "page_id", files.encode_payload(content, files.PDF_URI).alias("payload")
    )


def registry_use(spark, d):
    """Every registered parser and model with the number of jobs it runs."""
    used = (
        registry.resolve_jobs(tables.jobs(spark, d))
        .groupBy("parser", "model")
        .agg(F.count(F.lit(1)).alias("jobs"))
    )
    return (
        registry.registry(spark)
        .join(used, ["parser", "model"], "left")
        .select(
            "parser",
            "model",
            "position",
            "is_default",
            "credential",
            "medium",
            "max_tokens",
            "page_policy",
            F.coalesce("jobs", F.lit(0)).alias("jobs"),
        )
    )


def list_registry(spark, d):
    """Model list and default per parser with the jobs that ask for it."""
    asked = tables.jobs(spark, d).groupBy("parser").agg(F.count(F.lit(1)).alias("jobs"))
    return (
        registry.list_registry(spark)
        .join(asked, "parser", "left")
        .select("parser", "models", "default_model", F.coalesce("jobs", F.lit(0)).alias("jobs"))
    )


def resolve_jobs(spark, d):
    return registry.resolve_jobs(tables.jobs(spark, d))


def rejected_jobs(spark, d):
    return registry.rejected_jobs(tables.jobs(spark, d))


def build_requests(spark, d):
    units = tables.text_table(spark, d, "documents", "doc_id", "text").select(
        "doc_id",
        F.lit(0).alias("page_no"),
        files.encode_payload(F.encode("text", "UTF-8")).alias("payload"),
    )
    jobs = registry.resolve_jobs(tables.jobs(spark, d))
    requests = registry.build_requests(jobs, units, SYSTEM_TEXT)
    fields = (
        "model",
        "system",
        "prompt",
        "temperature",
        "top_p",
        "top_k",
        "max_tokens",
        "max_output_tokens",
        "num_predict",
        "max_completion_tokens",
        "payload",
    )
    body = F.json_tuple("request", *fields).alias(*[f"r_{f}" for f in fields])
    return (
        requests.select("doc_id", "page_no", "parser", body)
        .withColumn("r_payload", F.md5("r_payload"))
    )


def split_pages(spark, d):
    return convert.split_pages(tables.paged_documents(spark, d))


def page_count(spark, d):
    return convert.page_count(tables.paged_documents(spark, d))


def plan_units(spark, d):
    docs = tables.paged_documents(spark, d)
    parser = F.get(
        F.array(*[F.lit(p) for p in registry.PARSER_NAMES]),
        F.pmod(F.length("text"), F.lit(len(registry.PARSER_NAMES))),
    )
    return convert.plan_units(docs.withColumn("parser", parser), split_requested=True)


def _page_results(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages(spark, d).select("doc_id", "page_no", F.col("page_text").alias("markdown"))


def assemble_terminated(spark, d):
    return convert.assemble_pages(_page_results(spark, d), "terminated")


def assemble_joined(spark, d):
    return convert.assemble_pages(_page_results(spark, d), "joined")


def assemble_chunks(spark, d):
    return convert.assemble_chunks(tables.chunks(spark, d))


def local_converter(text: str, attempt: int) -> str:
    """A converter for trials: slow on one letter, unable to read another."""
    if "ç" in text and attempt == 1:
        raise TimeoutError("no answer yet")
    if "ß" in text:
        raise ValueError("unreadable letter")
    return "## " + text


def _converted(spark: SparkSession, d: str) -> DataFrame:
    retry = convert.Retry(transient=(TimeoutError,), sleep=lambda _: None)
    return convert.convert_units(spread(tables.pages(spark, d)), local_converter, retry)


def convert_units(spark, d):
    return _converted(spark, d)


def document_status(spark, d):
    return convert.document_status(_converted(spark, d))


def assemble_good(spark, d):
    return convert.assemble_good(_converted(spark, d))


def check_responses(spark, d):
    """Answers by role: system turns are empty, user turns missing."""
    turns = tables.table(spark, d, "conversations")
    answers = turns.select(
        tables.turn_document().alias("doc_id"),
        (tables.turn_position() + 1).alias("page_no"),
        tables.by_position(
            list(registry.PARSER_NAMES), tables.turn_parser(tables.turn_position())
        ).alias("parser"),
        F.when(F.col("role") == "system", "")
        .when(F.col("role") == "user", F.lit(None))
        .otherwise(F.col("text"))
        .alias("markdown"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )
    return convert.check_responses(answers)


def extracted_answers(spark, d):
    return answers.extract_answers(tables.answers(spark, d))


def elements_to_html(spark, d):
    return render.elements_to_html(tables.elements(spark, d))


def html_to_markdown(spark, d):
    pages = tables.text_table(spark, d, "pages", "page_id", "html")
    return pages.select("page_id", render.html_to_markdown("html").alias("markdown"))


def html_nested(spark, d):
    pages = tables.text_table(spark, d, "pages", "page_id", "html")
    return pages.select("page_id", markup.html_to_markdown_nested("html").alias("markdown"))


def linearize_layout(spark, d):
    return render.linearize_layout(tables.layout_blocks(spark, d))


def reading_order(spark, d):
    """Page texts of boxed blocks, which have no sequence."""
    return layout.ordered_text(layout.reading_order(tables.boxed_blocks(spark, d)))


def _conversation_stream(spark: SparkSession, d: str, out: str, again: bool = False) -> DataFrame:
    """The table in four shares, one after the other, each written by the tasks that read it and
    about one to a micro-batch. With ``again``, a fifth share holds the turns of
    every fifth conversation, which arrive once more."""
    rows = tables.table(spark, d, "conversations")
    part = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4))
    shares = [rows.where(part == k) for k in range(4)]
    if again:
        shares.append(rows.where(F.pmod("conv_id", F.lit(5)) == 0))
    for share in shares:
        share.write.mode("append").parquet(f"{out}/arriving")
    files = max(1, rows.rdd.getNumPartitions())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{out}/arriving")


def stream_chunks(spark, d):
    """Deltas through a stream into stored batches, then assembled."""
    out = workspace(spark, "chunks")
    arriving = tables.chunks_of(_conversation_stream(spark, d, out))
    chunk_stream.stream_chunks(arriving, f"{out}/table", f"{out}/offsets").awaitTermination()
    return chunk_stream.assembled(spark, f"{out}/table")


def stream_responses(spark, d):
    """Deltas through the stateful stream, each response given out once."""
    out = workspace(spark, "responses")
    arriving = tables.timed_chunks(_conversation_stream(spark, d, out))
    response_stream.assemble_stream(arriving, out, f"{out}/offsets").awaitTermination()
    return response_stream.responses(spark, out)


def stream_evaluate(spark, d):
    """Variants through a stream, scored batch by batch; some arrive again."""
    out = workspace(spark, "scores")
    arriving = tables.variants_of(_conversation_stream(spark, d, out, again=True))
    variant_stream.evaluate_stream(arriving, out, f"{out}/offsets").awaitTermination()
    names = [metrics.column_of(m) for m in metrics.METRICS]
    return _rounded(variant_stream.scores(spark, out), names).select(*PAIR, *names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "variant_pairs": pairs,
    "tiled_pairs": pairs_in_tiles,
    "word_overlap": _metric("word_overlap"),
    "word_stats": word_stats,
    "word_differences": word_differences,
    "tfidf_cosine": _metric("cosine"),
    "rouge_1": _metric("rouge-1"),
    "rouge_2": _metric("rouge-2"),
    "rouge_l": _metric("rouge-l"),
    "rouge_l_union": _metric(metrics.UNION_ROUGE_L),
    "levenshtein_ratio": _metric("levenshtein"),
    "levenshtein_distance": levenshtein_distance,
    "evaluate_pairs": evaluate_pairs,
    "strip_then_overlap": evaluate_modes,
    "evaluation_report": evaluation_report,
    "metrics_long": metrics_long,
    "similarity_matrix": similarity_matrix,
    "rank_against_checked": rank_against_checked,
    "metrics_csv": metrics_csv,
    "saved_markdown": saved_markdown,
    "variant_files": variant_files,
    "evaluate_files": evaluate_files,
    "strip_markdown": strip_markdown,
    "strip_plain_documents": strip_plain_documents,
    "truncate_for_rouge": truncate_for_rouge,
    "tfidf_terms": tfidf_terms,
    "overlap_words": overlap_words,
    "rouge_ngrams": rouge_ngrams,
    "find_variants": find_variants,
    "output_names": output_names,
    "variant_labels": variant_labels,
    "axis_labels": axis_labels,
    "validate_inputs": validate_inputs,
    "encode_payload": encode_payload,
    "registry": registry_use,
    "list_registry": list_registry,
    "resolve_jobs": resolve_jobs,
    "rejected_jobs": rejected_jobs,
    "build_requests": build_requests,
    "split_pages": split_pages,
    "page_count": page_count,
    "plan_units": plan_units,
    "assemble_terminated": assemble_terminated,
    "assemble_joined": assemble_joined,
    "assemble_chunks": assemble_chunks,
    "assemble_good": assemble_good,
    "convert_units": convert_units,
    "check_responses": check_responses,
    "extract_answers": extracted_answers,
    "document_status": document_status,
    "elements_to_html": elements_to_html,
    "html_to_markdown": html_to_markdown,
    "html_to_markdown_nested": html_nested,
    "linearize_layout": linearize_layout,
    "reading_order": reading_order,
    "stream_chunks": stream_chunks,
    "stream_responses": stream_responses,
    "stream_evaluate": stream_evaluate,
}
