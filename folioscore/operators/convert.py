"""Documents to pages, pages through a converter, pages back to documents."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscore.functions.columns import let
from folioscore.operators.registry import PAGE_POLICY, RETRYING, SPLIT_BY_DEFAULT
from folioscore.schemas import PAGE_RESULTS
from folioscore.sources import folder

# The page heading converters are told to emit, and what stands
# after each page of an assembled document.
PAGE_MARKER = r"(?dm)^###### Page \d+$"
PAGE_BREAK = "\n\n"


def _page_array(text: Column) -> Column:
    """Pages of a text in order; a blank part before the first marker is none."""
    parts = F.transform(
        F.split(text, PAGE_MARKER), lambda p: F.regexp_replace(p, r"^\n+|\n+\z", "")
    )
    return let(
        parts,
        lambda p: F.when(
            (F.size(p) > 1) & ~F.rlike(F.get(p, 0), F.lit(r"\S")), F.slice(p, 2, F.size(p))
        ).otherwise(p),
    )


def split_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, page_no, page_text``, pages numbered from 1.

    A document of markers only keeps one empty page per marker.
    """
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        F.posexplode(_page_array(F.col("text"))).alias("_pos", "page_text"),
    ).select(
        *[c for c in docs.columns if c != "text"],
        (F.col("_pos") + 1).alias("page_no"),
        "page_text",
    )


def page_count(docs: DataFrame) -> DataFrame:
    """Pages per document, counted inside the row."""
    return docs.select("doc_id", F.size(_page_array(F.col("text"))).alias("pages"))


def plan_units(docs: DataFrame, split_requested: bool | None = False) -> DataFrame:
    """Units of work of ``(doc_id, parser, text)``: the pages where the parser
    splits and there are several, else the whole document as unit 0.

    ``None`` leaves splitting to each parser's own default.
    """

    def parsers_with(policy: str) -> list[str]:
        return [p for p, v in PAGE_POLICY.items() if v == policy]

    parser = F.col("parser")
    always = parser.isin(parsers_with("always"))
    asked = parsers_with("if asked") if split_requested else []
    if split_requested is None:
        asked = list(SPLIT_BY_DEFAULT)
    keep = [c for c in docs.columns if c != "text"]
    staged = docs.withColumn("_pages", _page_array(F.col("text")))
    pages = F.transform(
        "_pages",
        lambda p, i: F.struct((i + 1).alias("page_no"), p.alias("unit_text")),
    )
    whole = F.array(F.struct(F.lit(0).alias("page_no"), F.col("text").alias("unit_text")))
    split = always | (parser.isin(asked) & (F.size("_pages") > 1))
    return staged.select(*keep, F.inline(F.when(split, pages).otherwise(whole)))


@dataclass(frozen=True)
class Retry:
    """At most ``attempts`` calls; waits grow by doubling between the bounds."""

    transient: tuple[type[BaseException], ...] = ()
    # Attempts and waits (seconds) of the retrying parsers.
    attempts: int = 3
    least: float = 4.0
    most: float = 15.0
    sleep: Callable[[float], None] = time.sleep

    def wait(self, attempt: int) -> float:
        return max(self.least, min(float(2 ** (attempt - 1)), self.most))


def retry_for(parser: str, transient: tuple[type[BaseException], ...]) -> Retry:
    """The parser's own policy: some try transient errors again, others never."""
    return Retry(transient=transient) if parser in RETRYING else Retry(attempts=1)


def convert_units(
    units: DataFrame,
    converter: Callable[[str, int], str | None],
    retry: Retry | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Page results of a user's converter, ``fn(page_text, attempt) -> markdown``.

    Errors become ``status`` and ``error``. Only ``retry.transient`` errors are
    tried again. ``concurrency`` spreads the units over that many tasks by their
    own key, so the pages of a long document do not meet in one. A task that is
    lost runs again, so the converter must be safe to repeat.
    """
    policy = retry or Retry(attempts=1)

    def call(text: str) -> tuple[str | None, str, str | None, int]:
        for attempt in range(1, policy.attempts + 1):
            try:
                return converter(text, attempt), "ok", None, attempt
            except policy.transient as exc:
                error = str(exc)
                if attempt < policy.attempts:
                    policy.sleep(policy.wait(attempt))
            except Exception as exc:  # noqa: BLE001 - becomes a status column
                return None, "error", str(exc), attempt
        return None, "error", error, policy.attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [call(t) for t in batch["page_text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "page_no": batch["page_no"],
                    "markdown": [d[0] for d in done],
                    "status": [d[1] for d in done],
                    "error": [d[2] for d in done],
                    "attempts": [d[3] for d in done],
                }
            )

    work = units.select("doc_id", "page_no", "page_text")
    if concurrency:
        work = work.repartition(concurrency, "doc_id", "page_no")
    return work.mapInPandas(run, PAGE_RESULTS)


def unit_digest(parser: Column, model: Column, text: Column) -> Column:
    """What names a request in the ledger: a digest of all that it depends on."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0001")) for c in (parser, model, text)]
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def convert_resumable(
    units: DataFrame,
    converter: Callable[[str, int], str | None],
    ledger: str,
    transient: tuple[type[BaseException], ...] = (),
    policy: Callable[[str], Retry] | None = None,
    window: int = 8,
    flush: int = 32,
    concurrency: int | None = None,
) -> DataFrame:
    """Page results of a user's converter, kept in a ledger as they are finished.

    ``units`` have ``doc_id, page_no, parser, page_text`` and may have ``model``; all columns but the text stay.
    A row's parser chooses its retry policy (``retry_for`` unless ``policy`` says otherwise). A task has
    ``window`` units under way, so their waits overlap, and writes finished ones to the ledger
    ``flush`` at a time. A unit whose request, by digest, is in the ledger with an end (converted, or an error
    that is not transient) is not sent again, by this job or a later one, whatever became of the task that sent it.
    """
    spark = units.sparkSession
    rule = policy or (lambda parser: retry_for(parser, transient))
    model = F.col("model") if "model" in units.columns else F.lit("")
    keyed = units.withColumn("_digest", unit_digest(F.col("parser"), model, F.col("page_text")))
    key = ["doc_id", "page_no", "_digest"]
    work = keyed.select(*key, "parser", "page_text").distinct()
    if folder.names(spark, ledger):
        work = work.join(_read_ledger(spark, ledger).where("final"), key, "left_anti")
    if concurrency:
        work = work.repartition(concurrency, "doc_id", "page_no")

    def call(row: tuple) -> tuple:
        doc_id, page_no, digest, parser, text = row
        how, error = rule(parser), None
        for attempt in range(1, how.attempts + 1):
            try:
                return doc_id, page_no, digest, converter(text, attempt), "ok", None, attempt, True
            except how.transient as exc:
                error = str(exc)
                if attempt < how.attempts:
                    how.sleep(how.wait(attempt))
            except Exception as exc:  # noqa: BLE001 - becomes a status column
                return doc_id, page_no, digest, None, "error", str(exc), attempt, True
        return doc_id, page_no, digest, None, "error", error, how.attempts, False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in batch.itertuples(index=False, name=None))
        finished: list[tuple] = []
        with ThreadPoolExecutor(window) as pool:
            pending = {pool.submit(call, r) for r in islice(rows, window)}
            while pending:
                done, pending = wait(pending, return_when=FIRST_COMPLETED)
                finished += [f.result() for f in done]
                pending |= {pool.submit(call, r) for r in islice(rows, len(done))}
                if len(finished) >= flush or not pending:
                    _to_ledger(ledger, finished)
                    yield pd.DataFrame({"n": [len(finished)]})
                    finished = []

    work.mapInPandas(run, "n long").agg(F.sum("n")).collect()
    results = _read_ledger(spark, ledger)
    last = F.max_by(F.struct("markdown", "status", "error", "attempts"), F.struct("final", "at")).alias("_r")
    newest = results.groupBy(*key).agg(last)
    keep = [c for c in units.columns if c not in ("page_text", "markdown", "status", "error", "attempts")]
    return keyed.join(newest, key, "left").select(*keep, "_r.*")


LEDGER = (
    "doc_id string, page_no int, _digest string, markdown string, status string, error string, "
    "attempts int, final boolean, at long"
)


def _read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    if not folder.names(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def _to_ledger(ledger: str, finished: list[tuple]) -> None:
    """Write finished units as a file of their own; it appears as a whole or not at all."""
    fs, root = pafs.FileSystem.from_uri(ledger)
    fs.create_dir(root)
    columns = list(zip(*finished))
    names = ("doc_id", "page_no", "_digest", "markdown", "status", "error", "attempts", "final")
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
    arrays = [pa.array([None if v is None else str(v) for v in c] if k == pa.string() else c, k) for c, k in zip(columns, kinds)]
    arrays.append(pa.array([time.time_ns()] * len(finished), pa.int64()))
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{root}/.{name}", compression=None) as out:
        pq.write_table(pa.Table.from_arrays(arrays, [*names, "at"]), out)
    fs.move(f"{root}/.{name}", f"{root}/{name}.parquet")


def check_responses(results: DataFrame, fail: bool = False) -> DataFrame:
    """Applies each parser's rule for empty answers to ``(…, parser, markdown,
    status, error)``: an error for openai and ollama, an empty text with a
    warning for unstructuredio. ``fail`` stops the job at the first error."""
    empty = F.coalesce(F.col("markdown"), F.lit("")) == ""
    answered = F.col("status") == "ok"
    refuses = F.col("parser").isin("openai", "ollama")
    tolerates = (F.col("parser") == "unstructuredio") & F.col("markdown").isNull()
    bad = answered & empty & refuses
    error = F.when(bad, F.concat(F.lit("Empty response from "), F.col("parser"))).otherwise(
        F.col("error")
    )
    status = (
        F.when(bad, "error").when(answered & tolerates, "warning").otherwise(F.col("status"))
    )
    rest = [c for c in results.columns if c not in ("markdown", "status", "error")]
    out = results.select(
        *rest,
        F.when(answered & tolerates, "").otherwise(F.col("markdown")).alias("markdown"),
        status.alias("status"),
        error.alias("error"),
    )
    if fail:
        out = out.withColumn(
            "status",
            F.when(F.col("status") == "error", F.raise_error(F.col("error"))).otherwise(
                F.col("status")
            ),
        )
    return out


def _ordered_text(order: str, text: str) -> Column:
    """Array of the group's texts in order; a missing text is an empty one."""
    return F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t")))),
        lambda x: F.coalesce(x["_t"], F.lit("")),
    )


def assemble_pages(
    results: DataFrame, mode: str = "terminated", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Page texts of each document in page order: a blank line after every page
    (``terminated``) or only between pages (``joined``).

    The group of a document is exactly the text of its output row.
    """
    if mode not in ("terminated", "joined"):
        raise ValueError(f"mode must be 'terminated' or 'joined', not {mode!r}")
    joined = F.array_join(_ordered_text("page_no", "markdown"), PAGE_BREAK)
    text = F.concat(joined, F.lit(PAGE_BREAK)) if mode == "terminated" else joined
    return results.groupBy(*keys).agg(text.alias("markdown"))


def document_status(results: DataFrame) -> DataFrame:
    """Per document: whether all pages are good, and the first error if not.

    Only counters and one error travel to the reducers, never page texts.
    """
    bad = F.col("status") == "error"
    return (
        results.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(bad).alias("failed"),
            F.min(F.when(bad, F.col("page_no"))).alias("first_failed_page"),
            F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("page_no"))).alias(
                "first_error"
            ),
        )
        .withColumn("status", F.when(F.col("failed") > 0, "quarantined").otherwise("ok"))
    )


def assemble_good(results: DataFrame, mode: str = "terminated") -> DataFrame:
    """Documents whose pages are all good; one bad page drops the document.

    The verdict is an aggregate next to the texts, so this is one shuffle.
    """
    joined = F.array_join(_ordered_text("page_no", "markdown"), PAGE_BREAK)
    text = F.concat(joined, F.lit(PAGE_BREAK)) if mode == "terminated" else joined
    return (
        results.groupBy("doc_id")
        .agg(text.alias("markdown"), F.bool_and(F.col("status") != "error").alias("_good"))
        .where("_good")
        .drop("_good")
    )


def assemble_chunks(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Deltas of each response in sequence order; a null delta counts as empty."""
    filled = chunks.withColumn("delta", F.coalesce("delta", F.lit("")))
    return filled.groupBy(*keys).agg(
        F.array_join(_ordered_text("seq", "delta"), "").alias("markdown")
    )
