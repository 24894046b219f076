"""Functions over Arrow columns, of a row or of many texts, as Spark column functions."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

PIECE = 500


def row_udf(result: str, make: Callable[[], Callable]):
    """Column function from a row function; structs are returned as tuples in field order.

    ``make`` runs once per task, so tables that the row function needs are built once. Only the
    columns given to the function pass through Python; all others stay with Spark.
    """
    kind: DataType = _parse_datatype_string(result)
    arrow_kind = to_arrow_type(kind)
    names = kind.fieldNames() if isinstance(kind, T.StructType) else None

    def packed(values: list) -> pa.Array:
        if names is None:
            return pa.array(values, arrow_kind)
        fields = list(zip(*values)) or [[] for _ in names]
        return pa.StructArray.from_arrays(
            [pa.array(f, arrow_kind.field(i).type) for i, f in enumerate(fields)], names
        )

    def run(batches: Iterator) -> Iterator:
        row = make()
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            parts = [packed([])]
            # a piece at a time, so that few rows are Python objects at once
            for k in range(0, len(columns[0]), PIECE):
                pieces = (c.slice(k, PIECE) for c in columns)
                parts.append(packed([row(*(v.as_py() for v in r)) for r in zip(*pieces)]))
            yield pa.concat_arrays(parts)

    with warnings.catch_warnings():  # the number of columns is not known for a type hint
        warnings.simplefilter("ignore")
        return F.arrow_udf(run, result, ArrowUDFType.SCALAR_ITER)


def pieces_of(texts: pa.Array, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of runs of rows that hold about ``most_bytes``; a longer text stands alone."""
    if pa.types.is_list(texts.type):
        sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False) * texts.type.value_type.byte_width
    else:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        end = int(np.searchsorted(ends, before + most_bytes, "right"))
        end = min(max(end, start + 1), start + most_rows)
        yield start, end - start
        start = end


def text_udf(result: str, make: Callable[[], Callable], most_bytes: int = 4 << 20, most_rows: int = 4096):
    """Column function from a function of many texts: ``list[bytes | None]`` and further columns.

    The function that ``make`` builds, once per task, returns an Arrow array of ``result`` with a
    row per text. Texts come in pieces of about ``most_bytes``, so the memory of a piece is bounded
    by that and by the longest single text.
    """
    arrow_kind = to_arrow_type(_parse_datatype_string(result))

    def run(batches: Iterator) -> Iterator:
        work = make()
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            texts = columns[0].cast(pa.large_binary())
            parts = [pa.array([], arrow_kind)]
            for start, n in pieces_of(texts, most_bytes, most_rows):
                rest = (c.slice(start, n) for c in columns[1:])
                parts.append(work(texts.slice(start, n).to_pylist(), *rest).cast(arrow_kind))
            yield pa.concat_arrays(parts)

    with warnings.catch_warnings():  # the number of columns is not known for a type hint
        warnings.simplefilter("ignore")
        return F.arrow_udf(run, result, ArrowUDFType.SCALAR_ITER)


def map_texts(
    df: DataFrame,
    text: str,
    schema: T.StructType,
    make: Callable[[], Callable],
    most_bytes: int = 1 << 20,
    most_rows: int = 4096,
) -> DataFrame:
    """Rows made of pieces of ``df`` by a function of the texts and a batch of the other columns.

    The function that ``make`` builds, once per task, returns a batch of ``schema``. It is handed on before the next
    piece is worked on, so a task holds the results of one piece, however many rows Spark sends at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            place = batch.schema.get_field_index(text)
            texts = batch.column(place)
            if not pa.types.is_list(texts.type):
                texts = texts.cast(pa.large_binary())
            rest = pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != place],
                [n for i, n in enumerate(batch.schema.names) if i != place],
            )
            for start, n in pieces_of(texts, most_bytes, most_rows):
                yield work(texts.slice(start, n), rest.slice(start, n))

    return df.mapInArrow(run, schema)
