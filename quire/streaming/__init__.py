"""Document operators on streams of files: stateless maps, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import frames
from ..sources.files import stream_documents


def render_stream(spark: SparkSession, path: str, what: str, suffix: str | None = None, **options) -> DataFrame:
    """path, name, what, status and message of every new file below path."""
    return frames.render_as(stream_documents(spark, path, suffix), what, keys=["path", "name"], **options)


def write_stream(df: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """The rows as Parquet, each file once; available_now stops after what is there."""
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
