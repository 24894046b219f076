"""A folder of Markdown files as a Spark data source: reader, stream reader and writer.

``register(spark)`` makes the format ``markdown_files`` known. Files are named
``<stem>_<parser>[_<model>].md``, as the converters save them, and hold exactly the text, as UTF-8. A
model's name may have a ``/``; the file then lies in a folder below, and its name is the path from the root.

*Reading* gives ``filestem, parser, file, ord, text``. The stem is what stands before the last
``_<parser>`` that a model or the suffix follows, or before the last one at all, ``ord`` the place of the parser in the option ``parsers``. Names are listed once, filters on
``filestem``, ``parser``, ``file`` and ``ord`` are applied to them, and only files that pass are opened;
a partition is a range of names. A file that vanishes between listing and reading fails the job.

*Streaming* gives every file once, and once more when it is replaced. What was handed out is kept as
numbered lists in the folder of the option ``log``, so files may appear in any order and with any time.

*Writing* takes ``file, text``. A task writes to its own hidden folder; when all tasks are done the files are
moved to their places, and until then readers see nothing of them. A task or job that fails takes its
files away. A file of the same name is replaced; others are never touched. Rows with a null text are not saved.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from folioscore.sources.files import DEFAULT_PARSERS

FORMAT = "markdown_files"
SCHEMA = "filestem string, parser string, file string, ord int, text string"
FILES_A_PARTITION = 256
_MOVES = 32
_STOPPING = 30
_DAY = 86_400 * 10**9
_BATCH_BYTES = 8 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarkdownFiles)


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def _hidden(name: str) -> bool:
    return any(part.startswith((".", "_")) for part in name.split("/")[:-1])


@dataclass(frozen=True)
class Listed:
    """A file by the parts of its name."""

    filestem: str
    parser: str
    file: str
    ord: int
    mtime: int | None
    size: int


def split_name(file: str, parsers: Sequence[str]) -> tuple[str, str, int] | None:
    """Stem, parser and its place; none for a name that is no variant's."""
    if not file.endswith(".md"):
        return None
    names = "|".join(map(re.escape, parsers))
    for follows in (r"(?:_|\.md$)", ""):
        ends = [m.start() for m in re.finditer(rf"_(?=(?:{names}){follows})", file)]
        if ends:
            break
    else:
        return None
    rest = file[ends[-1] + 1 :]
    ord_ = next(i for i, p in enumerate(parsers) if rest.startswith(p))
    return file[: ends[-1]], parsers[ord_], ord_


def listing(uri: str, parsers: Sequence[str]) -> list[Listed]:
    """Variants in a folder and below, by name; no file is opened."""
    fs, root = _folder(uri)
    out = []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        name = info.path[len(root) + 1 :]
        if info.type == pafs.FileType.File and not _hidden(name):
            parts = split_name(name, parsers)
            if parts is not None:
                out.append(Listed(parts[0], parts[1], name, parts[2], info.mtime_ns, info.size))
    return sorted(out, key=lambda x: x.file)


@dataclass
class Names(InputPartition):
    files: list[Listed]


def _ranges(files: list[Listed]) -> list[Names]:
    return [Names(files[k : k + FILES_A_PARTITION]) for k in range(0, len(files), FILES_A_PARTITION)]


def _read(uri: str, files: list[Listed]) -> Iterator[pa.RecordBatch]:
    fs, root = _folder(uri)
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        names = ["filestem", "parser", "file", "ord", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for f in files:
        with fs.open_input_stream(f"{root}/{f.file}", compression=None) as stream:
            text = stream.read().decode("utf-8")
        rows.append((f.filestem, f.parser, f.file, f.ord, text))
        size += len(text)
        if size >= _BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class Reader(DataSourceReader):
    def __init__(self, uri: str, parsers: Sequence[str]):
        self.uri, self.parsers = uri, tuple(parsers)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        """Take the filters on a file's name; the text's stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in ("filestem", "parser", "file", "ord"):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif not isinstance(f, IsNotNull):  # the names are never null
                yield f

    def wanted(self) -> list[Listed]:
        def passes(f: Listed) -> bool:
            return all(
                getattr(f, name) in value if how == "in" else getattr(f, name).startswith(value)
                for name, how, value in self.tests
            )

        return [f for f in listing(self.uri, self.parsers) if passes(f)]

    def partitions(self) -> list[Names]:
        return _ranges(self.wanted()) or [Names([])]

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition.files)


class StreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, parsers: Sequence[str], log: str):
        self.uri, self.parsers, self.log = uri, tuple(parsers), log

    def _lists(self) -> list[int]:
        fs, root = _folder(self.log)
        fs.create_dir(root)
        found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root))]
        return sorted(int(n[:-5]) for n in found if re.fullmatch(r"\d+\.json", n))

    def _list(self, number: int) -> list[Listed]:
        fs, root = _folder(self.log)
        with fs.open_input_stream(f"{root}/{number}.json", compression=None) as stream:
            return [Listed(*x) for x in json.loads(stream.read())]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"lists": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """List what is new since the last list, if anything is."""
        numbers = self._lists()
        seen = {(f.file, f.mtime, f.size) for n in numbers for f in self._list(n)}
        new = [f for f in listing(self.uri, self.parsers) if (f.file, f.mtime, f.size) not in seen]
        last = numbers[-1] if numbers else 0
        if not new:
            return {"lists": last}
        fs, root = _folder(self.log)
        rows = [(f.filestem, f.parser, f.file, f.ord, f.mtime, f.size) for f in new]
        with fs.open_output_stream(f"{root}/.{last + 1}", compression=None) as stream:
            stream.write(json.dumps(rows).encode())
        fs.move(f"{root}/.{last + 1}", f"{root}/{last + 1}.json")
        return {"lists": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Names]:
        files = {f.file: f for n in range(start["lists"] + 1, end["lists"] + 1) for f in self._list(n)}
        return _ranges(sorted(files.values(), key=lambda f: f.file)) or [Names([])]

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition.files)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri
        self.staging = f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Write the rows of a task to a folder of its own."""
        fs, root = _folder(self.uri)
        mine, count = f"{self.staging}/{uuid.uuid4().hex}", 0
        made: set[str] = set()
        try:
            for batch in iterator:
                names, texts = batch.column("file"), batch.column("text")
                for name, text in zip(names, texts):
                    if not text.is_valid:
                        continue
                    path = f"{root}/{mine}/{name.as_py()}"
                    parent = path.rsplit("/", 1)[0]
                    if parent not in made:
                        fs.create_dir(parent)
                        made.add(parent)
                    with fs.open_output_stream(path, compression=None) as stream:
                        stream.write(text.as_buffer())
                    count += 1
        except BaseException:
            if made:
                fs.delete_dir(f"{root}/{mine}")
            raise
        return Staged(mine, count)

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the files of all tasks to their places."""
        fs, root = _folder(self.uri)
        moves = []
        for message in messages:
            if message is not None and message.files:
                base = f"{root}/{message.folder}"
                found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
                moves += [(i.path, f"{root}/{i.path[len(base) + 1:]}") for i in found if i.type == pafs.FileType.File]
        for parent in {target.rsplit("/", 1)[0] for _, target in moves}:
            fs.create_dir(parent)

        def move(pair: tuple[str, str]) -> None:
            try:
                fs.move(*pair)
            except OSError:  # stores that do not replace a file by moving
                fs.delete_file(pair[1])
                fs.move(*pair)

        with ThreadPoolExecutor(_MOVES) as pool:
            list(pool.map(move, moves))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        """Take away what was written; tasks that are still being stopped may write a little more."""
        quiet = 0
        for _ in range(_STOPPING):
            quiet = 0 if self._clear() else quiet + 1
            if quiet == 3:
                break
            time.sleep(0.3)

    def _clear(self) -> bool:
        """Remove the hidden folder, and ones that a lost driver left more than a day ago."""
        fs, root = _folder(self.uri)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return False
        old = time.time_ns() - _DAY
        gone = False
        for info in fs.get_file_info(pafs.FileSelector(root)):
            mine = info.base_name == self.staging
            if mine or (info.base_name.startswith(".writing-") and (info.mtime_ns or old) < old):
                fs.delete_dir(info.path)
                gone |= mine
        return gone


class MarkdownFiles(DataSource):
    """The format ``markdown_files``; options ``path``, ``parsers`` (parted by commas) and ``log``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _parsers(self) -> tuple[str, ...]:
        return tuple(self.options.get("parsers", ",".join(DEFAULT_PARSERS)).split(","))

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._parsers())

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        if "log" not in self.options:
            raise ValueError("a stream of files needs the option log, a folder of its own")
        return StreamReader(self.options["path"], self._parsers(), self.options["log"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def scan_files(
    spark: SparkSession, path: str, parsers: Sequence[str] = DEFAULT_PARSERS
) -> DataFrame:
    """Variants of a folder; filters on name columns choose the files that are opened."""
    register(spark)
    return spark.read.format(FORMAT).option("parsers", ",".join(parsers)).load(path)


def stream_files(
    spark: SparkSession, path: str, log: str, parsers: Sequence[str] = DEFAULT_PARSERS
) -> DataFrame:
    """Variants of a folder as they are saved."""
    register(spark)
    options = {"parsers": ",".join(parsers), "log": log}
    return spark.readStream.format(FORMAT).options(**options).load(path)


def save_files(results: DataFrame, path: str, tasks: int | None = None) -> None:
    """Save ``file, text`` as files, each name once.

    Of several texts of one name the greatest is saved. ``tasks`` bounds how many write at a time.
    """
    register(results.sparkSession)
    named = results.where("text is not null").groupBy("file").agg(F.max("text").alias("text"))
    if tasks:
        named = named.repartition(tasks, "file")
    named.write.format(FORMAT).mode("append").save(path)
