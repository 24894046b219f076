"""Small files and listings in a folder that only Spark's file systems can open."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none where there is no folder."""
    fs, place = _open(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, place = _open(spark, path)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _open(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the path and rename, so that a reader sees the whole text or no file."""
    fs, place = _open(spark, path)
    parent, name = path.rsplit("/", 1)
    _, beside = _open(spark, f"{parent}/.{name}.part")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(beside, place):
        raise OSError(f"cannot rename to {path}")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all that is in it, if it is there."""
    fs, place = _open(spark, path)
    fs.delete(place, True)
