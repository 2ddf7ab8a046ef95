"""Streams of documents, one on each line. Stateless: every line stands for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as c
from ..sources import parsed_lines


def stream_document_lines(spark: SparkSession, path: str, mode: str = "PERMISSIVE", max_files: int | None = None, **options) -> DataFrame:
    """line, doc and error of each line of the files that come to path."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parsed_lines(reader.load(path), mode, **options)


def write_stream(df: DataFrame, doc: str, path: str, checkpoint: str, available_now: bool = True, **style) -> StreamingQuery:
    """Prints documents to text files, exactly once for each line of the source."""
    out = df.select(c.json_print(doc, **({"pretty": False, "once": True} | style)).alias("value")).where("value is not null")
    writer = out.writeStream.format("text").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
