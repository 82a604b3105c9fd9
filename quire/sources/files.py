"""Folders of documents as DataFrames, by Spark's binary file source: any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

#: Bytes of documents in a scan task, about; their files are small and their parsing is not.
SPLIT = "16m"


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), "modificationTime", "length", "content")


def read_documents(spark: SparkSession, path: str, suffix: str | None = None, recursive: bool = False) -> DataFrame:
    """path, name, modificationTime, length, content and format (by the first bytes) of the files below path.

    suffix (".hwpx") is compared without case. Columns that a query leaves out are not read: without content and
    format a scan lists files only.
    """
    df = _named(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path))
    if suffix:
        df = df.where(F.lower("name").endswith(suffix.lower()))
    return df.withColumn("format", scalar.detect_format(F.col("content")))


def stream_documents(spark: SparkSession, path: str, suffix: str | None = None, max_files: int = 1000) -> DataFrame:
    """The same as a stream of new files. Document operators are maps, so they run on it unchanged, without state."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = _named(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path))
    if suffix:
        df = df.where(F.lower("name").endswith(suffix.lower()))
    return df.withColumn("format", scalar.detect_format(F.col("content")))


def base_name(name):
    """A file's name without its last suffix."""
    return F.regexp_replace(name, "\\.[^.]*$", "")


def kind_by_name(name):
    """The kind that text and Markdown commands take from a file's suffix."""
    lower = F.lower(name)
    return F.when(lower.endswith(".hwp"), "hwp").when(lower.endswith(".md"), "md").when(lower.endswith(".html") | lower.endswith(".htm"), "html").when(lower.endswith(".txt"), "txt").otherwise("hwpx")
