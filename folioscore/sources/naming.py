"""File names of conversions and the labels read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Last component without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def output_name(path: Column, parser: Column, model: Column) -> Column:
    """``<stem>_<parser>[_<model>].md``; a null or empty model adds nothing."""
    suffix = F.when(F.coalesce(model, F.lit("")) != "", F.concat(F.lit("_"), model)).otherwise("")
    return F.concat(stem(path), F.lit("_"), parser, suffix, F.lit(".md"))


def variant_label(file: Column) -> Column:
    """What follows the first ``_`` of the base name, without a final ``.md``."""
    return F.regexp_replace(F.regexp_replace(basename(file), r"^[^_]*_", ""), r"\.md$", "")


def axis_label(file: Column) -> Column:
    """Last two ``_`` tokens of the path without ``.md``; only the last for textract."""
    parts = F.split(F.replace(file, F.lit(".md"), F.lit("")), "_")
    keep = F.when(F.contains(file, F.lit("textract")), F.lit(1)).otherwise(F.lit(2))
    take = F.least(keep, F.size(parts))
    return F.array_join(F.slice(parts, -take, take), "_")
