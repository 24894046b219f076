"""Readers of variants and source documents, and checks of requested inputs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.sources.naming import basename

# The parsers compared when none are named, in their order.
DEFAULT_PARSERS = ("anthropic", "googleai", "mistral", "openai", "unstructuredio", "textract")

PDF_URI = "data:application/pdf;base64,"
PNG_URI = "data:image/png;base64,"


def parser_list(spark: SparkSession, parsers: Sequence[str]) -> DataFrame:
    """The requested parsers with their position; as small as the request."""
    return spark.createDataFrame(
        [(i, p) for i, p in enumerate(parsers)], "ord int, parser string"
    )


def match_variants(
    files: DataFrame, filestem: Column | str, parsers: Sequence[str] = DEFAULT_PARSERS
) -> DataFrame:
    """Files named ``<filestem>_<parser>*.md``, one row each, with the position
    of the parser as ``ord``.

    ``(ord, file)`` orders the variants of a stem, so no window has to number
    them. A file that two prefixes match is kept once, under the first.
    """
    stem = F.lit(filestem) if isinstance(filestem, str) else filestem
    name = basename(F.col("file"))
    after = F.substring(name, F.length(stem) + F.lit(2), F.length(name))
    named = F.startswith(name, F.concat(stem, F.lit("_"))) & F.endswith(name, F.lit(".md"))
    position = F.lit(None).cast("int")
    chosen = F.lit(None).cast("string")
    for i in reversed(range(len(parsers))):
        hit = F.startswith(after, F.lit(parsers[i]))
        position = F.when(hit, F.lit(i)).otherwise(position)
        chosen = F.when(hit, F.lit(parsers[i])).otherwise(chosen)
    return (
        files.withColumn("filestem", stem)
        .where(named)
        .withColumn("ord", position)
        .withColumn("parser", chosen)
        .where(F.col("ord").isNotNull())
    )


def read_markdown(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, text)`` of every Markdown file, whole, as UTF-8.

    Paths are as the file system has them, not percent-encoded.

    A file that vanishes between listing and reading fails the job.
    """
    return (
        spark.read.option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", False)
        .text(path, wholetext=True)
        .select(
            F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
            F.col("value").alias("text"),
        )
    )


def scan_variants(
    spark: SparkSession,
    path: str,
    filestem: str,
    parsers: Sequence[str] = DEFAULT_PARSERS,
) -> DataFrame:
    """Variants of one document; raises where there is none."""
    found = match_variants(read_markdown(spark, path), filestem, parsers).select(
        "filestem", "parser", "file", "ord", "text"
    )
    if found.select("file").isEmpty():
        raise ValueError(f"No files found for filestem {filestem} and parsers {list(parsers)}")
    return found


def scan_all_variants(
    spark: SparkSession,
    path: str,
    parsers: Sequence[str] = DEFAULT_PARSERS,
    stems: DataFrame | None = None,
) -> DataFrame:
    """Variants of every document in a folder; ``file`` is the name without its folder.

    With ``stems`` (column ``filestem``) these are the documents. Otherwise the
    stem is what stands before the last ``_<parser>`` that a model or the suffix follows
    (a model may begin with its parser's name), or before the last one at all.
    """
    files = read_markdown(spark, path).withColumn("file", basename(F.col("file")))
    alternatives = "|".join(re.escape(p) for p in parsers)

    def places(pattern: str) -> Column:
        """Ends of possible stems: places where a parser's name may begin."""
        return F.filter(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("file"), F.lit(1))),
                lambda i: F.when(F.substring(F.col("file"), i, F.length("file")).rlike(pattern), i - 1),
            ),
            lambda i: i.isNotNull(),
        )

    ends = places(rf"^_(?:{alternatives})")
    whole = places(rf"^_(?:{alternatives})(?:_|\.md$)")
    stem = F.left(F.col("file"), F.coalesce(F.array_max(whole), F.array_max(ends), F.lit(0)))
    if stems is None:
        named = files.withColumn("_stem", stem)
    else:
        possible = F.transform(ends, lambda i: F.left(F.col("file"), i))
        named = files.withColumn("_stem", F.explode(possible)).join(
            stems.select(F.col("filestem").alias("_stem")).distinct(), "_stem"
        )
    return match_variants(named, F.col("_stem"), parsers).select(
        "filestem", "parser", "file", "ord", "text"
    )


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Bytes of the source documents under a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """``path, is_file`` of everything under a folder, for ``validate_inputs``.

    Only names are read: the content column is never asked for. Folders are seen
    through the files below them.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))
    )
    parts = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    folders = found.select(F.explode(parents).alias("path")).distinct()
    return found.withColumn("is_file", F.lit(True)).unionByName(
        folders.withColumn("is_file", F.lit(False))
    )


def validate_inputs(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``verdict`` to requested paths: ``missing``, ``not a file``,
    ``wrong suffix`` (checked in this order) or ``ok``.

    ``listing`` has ``path`` and ``is_file``.
    """
    known = listing.select("path", F.col("is_file").alias("_is_file"))
    path = F.col("path")
    return requested.join(known, "path", "left").select(
        *[F.col(c) for c in requested.columns],
        F.when(F.col("_is_file").isNull(), "missing")
        .when(~F.col("_is_file"), "not a file")
        .when(~F.endswith(F.lower(basename(path)), F.lit(".pdf")), "wrong suffix")
        .when(F.lower(basename(path)) == ".pdf", "wrong suffix")
        .otherwise("ok")
        .alias("verdict"),
    )


def encode_payload(content: Column, prefix: str = "") -> Column:
    """Standard base64 on one line, after an optional data-URI prefix."""
    encoded = F.regexp_replace(F.base64(content), r"[\r\n]+", "")
    return F.concat(F.lit(prefix), encoded) if prefix else encoded
