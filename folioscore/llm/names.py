"""Names for helper columns that do not clash with given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``name`` under as many underscores as it takes for ``df`` not to have it, in any case."""
    taken = {c.lower() for c in df.columns}
    while (name := "_" + name).lower() in taken:
        pass
    return name
