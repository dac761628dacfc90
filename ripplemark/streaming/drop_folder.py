"""Containers that arrive in a folder: each file's chunks once, whatever the number of restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.container import chunks_of

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_chunks(spark: SparkSession, folder: str, glob: str = "*.{dcr,cct,cst,dir,dxr,cxt}") -> DataFrame:
    """A stream of the chunks of new files; no state is kept beyond the source's list of files seen."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(folder)
    return chunks_of(files)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of files not seen yet to the Parquet table, then stop."""
    return stream_chunks(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
