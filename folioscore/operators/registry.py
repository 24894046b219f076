"""Parser registry and the resolution of conversion jobs against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parsers in their order, with models in their order.
# parser, default model, models, credential variable, input medium, largest output
PARSERS = (
    (
        "anthropic",
        "claude-3-7-sonnet-20250219",
        ("claude-3-7-sonnet-20250219", "claude-3-5-sonnet-20241022"),
        "ANTHROPIC_API_KEY",
        "pdf base64",
        8192,
    ),
    (
        "googleai",
        "gemini-2.0-flash",
        (
            "gemini-1.5-flash",
            "gemini-2.0-flash",
            "gemini-2.0-flash-thinking-exp-01-21",
            "gemini-2.5-pro-exp-03-25",
        ),
        "GOOGLE_API_KEY",
        "file upload",
        65536,
    ),
    (
        "mistral",
        "mistral-ocr-latest",
        ("mistral-ocr-latest",),
        "MISTRAL_API_KEY",
        "signed url",
        8192,
    ),
    (
        "ollama",
        "gemma3:4b",
        ("gemma3:4b", "gemma3:12b", "llama3.2-vision:11b"),
        None,
        "page images",
        8192,
    ),
    (
        "openai",
        "gpt-4o",
        ("gpt-4o", "gpt-4o-mini", "gpt-4.5-preview", "o1"),
        "OPENAI_API_KEY",
        "pdf data uri",
        8192,
    ),
    ("textract", "", (), "AWS_REGION", "file", 0),
    (
        "unstructuredio",
        "gpt-4o",
        ("gpt-4o", "claude-3-5-sonnet-20241022", "gemini-2.0-flash-001", "hi-res", "fast"),
        "UNSTRUCTURED_API_KEY",
        "file",
        8192,
    ),
    (
        "huggingface",
        "meta-llama/Llama-4-Scout-17B-16E-Instruct",
        (
            "meta-llama/Llama-4-Scout-17B-16E-Instruct",
            "meta-llama/Llama-4-Maverick-17B-128E-Instruct",
            "Qwen/Qwen2.5-VL-7B-Instruct",
        ),
        "HUGGINGFACE_API_KEY",
        "page image",
        8192,
    ),
)
PARSER_NAMES = tuple(p[0] for p in PARSERS)

# Page policy per parser. "if asked" splits on request, "always"
# works page by page, "never" sends the document whole.
PAGE_POLICY = {
    "anthropic": "if asked",
    "googleai": "if asked",
    "mistral": "never",
    "ollama": "never",
    "openai": "if asked",
    "textract": "if asked",
    "unstructuredio": "never",
    "huggingface": "always",
}

# Parsers that split without being asked, and parsers whose calls
# are tried again after transient errors.
SPLIT_BY_DEFAULT = ("anthropic", "openai", "textract")
RETRYING = ("googleai", "huggingface")

# Name of the output limit in a request; top_k is sent by the
# parsers of the second list only. Parsers absent here take no chat request.
LIMIT_FIELD = {
    "anthropic": "max_tokens",
    "googleai": "max_output_tokens",
    "ollama": "num_predict",
    "openai": "max_completion_tokens",
    "huggingface": "max_tokens",
}
SENDS_TOP_K = ("anthropic", "googleai", "ollama")

# Default sampling parameters and request wording.
TEMPERATURE, TOP_P, TOP_K = 0.1, 0.1, 40
PDF_PROMPT = "Convert the attached pdf to markdown format for me please."
IMAGE_PROMPT = "Convert this image to markdown format for me please."


REGISTRY_COLUMNS = (
    "parser_pos",
    "parser",
    "model",
    "position",
    "is_default",
    "credential",
    "medium",
    "max_tokens",
    "page_policy",
    "sends_top_k",
    "limit_field",
)


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return f"'{value}'" if isinstance(value, str) else str(value)


def registry(spark: SparkSession) -> DataFrame:
    """One row per parser and model; a parser without models has an empty one.

    Inline values, so that the planner knows the table whole.
    """
    rows = []
    for parser_pos, (name, default, models, credential, medium, limit) in enumerate(PARSERS):
        for position, model in enumerate(models or ("",)):
            row = (
                parser_pos,
                name,
                model,
                position,
                model == default,
                credential,
                medium,
                limit,
                PAGE_POLICY[name],
                name in SENDS_TOP_K,
                LIMIT_FIELD.get(name),
            )
            rows.append("(" + ", ".join(_literal(v) for v in row) + ")")
    columns = ", ".join(REGISTRY_COLUMNS)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS registry({columns})")


def parsers(spark: SparkSession) -> DataFrame:
    """One row per parser: its default model and request facts."""
    return registry(spark).where("is_default").drop("position", "is_default")


def _verdicts(jobs: DataFrame) -> DataFrame:
    """Jobs with the model they run and ``reason`` where they cannot run.

    The registry has some twenty rows whatever the number of jobs, so it is
    broadcast.
    """
    spark = jobs.sparkSession
    defaults = parsers(spark).select("parser", F.col("model").alias("_default"))
    known = registry(spark).select("parser", F.col("model").alias("_known"))
    wanted = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.col("_default"))
    return (
        jobs.join(F.broadcast(defaults), "parser", "left")
        .withColumn("_model", wanted)
        .join(
            F.broadcast(known.withColumnRenamed("parser", "_parser")),
            (F.col("parser") == F.col("_parser")) & (F.col("_model") == F.col("_known")),
            "left",
        )
        .withColumn(
            "reason",
            F.when(F.col("_default").isNull(), "unsupported parser").when(
                F.col("_known").isNull(), "unsupported model"
            ),
        )
    )


def resolve_jobs(jobs: DataFrame) -> DataFrame:
    """Runnable jobs, a missing or empty model replaced by the default one."""
    keep = [F.col("_model").alias("model") if c == "model" else F.col(c) for c in jobs.columns]
    return _verdicts(jobs).where(F.col("reason").isNull()).select(*keep)


def rejected_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that name an unknown parser or a model the parser does not have."""
    return (
        _verdicts(jobs)
        .where(F.col("reason").isNotNull())
        .select(*[F.col(c) for c in jobs.columns], "reason")
    )


def list_registry(spark: SparkSession) -> DataFrame:
    """Per parser: its models in order, comma-separated, and the default."""
    in_order = F.sort_array(F.collect_list(F.struct("position", "model")))
    return (
        registry(spark)
        .groupBy("parser_pos", "parser")
        .agg(
            F.array_join(F.transform(in_order, lambda x: x["model"]), ", ").alias("models"),
            F.max(F.when(F.col("is_default"), F.col("model"))).alias("default_model"),
        )
    )


def build_requests(
    jobs: DataFrame,
    units: DataFrame,
    system: str,
    temperature: float = TEMPERATURE,
    top_p: float = TOP_P,
    top_k: int = TOP_K,
) -> DataFrame:
    """One JSON request per unit of every resolved job.

    ``units`` has ``doc_id, page_no, payload``. Fields a parser does not send
    are left out of its request.
    """
    facts = parsers(jobs.sparkSession).select(
        "parser", "medium", "max_tokens", "sends_top_k", "limit_field"
    )
    chat = F.col("limit_field").isNotNull()
    limits = [
        F.when(F.col("limit_field") == name, F.col("max_tokens")).alias(name)
        for name in dict.fromkeys(LIMIT_FIELD.values())
    ]
    uri = (
        F.when(F.col("medium") == "pdf data uri", F.lit("data:application/pdf;base64,"))
        .when(F.col("medium") == "page image", F.lit("data:image/png;base64,"))
        .otherwise(F.lit(""))
    )
    prompt = F.when(F.col("parser") == "huggingface", F.lit(IMAGE_PROMPT)).otherwise(
        F.lit(PDF_PROMPT)
    )
    body = F.to_json(
        F.struct(
            F.nullif(F.col("model"), F.lit("")).alias("model"),
            F.when(chat, F.lit(system)).alias("system"),
            F.when(chat, prompt).alias("prompt"),
            F.when(chat, F.lit(temperature)).alias("temperature"),
            F.when(chat, F.lit(top_p)).alias("top_p"),
            F.when(F.col("sends_top_k"), F.lit(top_k)).alias("top_k"),
            *limits,
            F.concat(uri, F.col("payload")).alias("payload"),
        )
    )
    return (
        jobs.join(units, "doc_id")
        .join(F.broadcast(facts), "parser")
        .select("doc_id", "page_no", "parser", "model", body.alias("request"))
    )
