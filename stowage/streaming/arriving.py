"""Archives arriving in a folder, as a stream of listing or digest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Options
from ..sources import archive


def arriving(spark: SparkSession, folder: str, options: Options | None = None, pattern: str = "*", files_each: int = 100, digests: bool = False) -> DataFrame:
    """A streaming frame of entries (or digests) of new archives under a folder, with the time each file was last changed.

    Each archive is read once, whole; at most files_each start in a trigger.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each).load(folder)
    return archive.digests(files, options) if digests else archive.entries(files, options)


def totals(rows: DataFrame) -> DataFrame:
    """Running entries, bytes and failures by format; for complete output mode."""
    return rows.groupBy("format").agg(F.count("index").alias("entries"), F.sum("bytes").alias("bytes"), F.count("error").alias("failures"))


def write_digests(rows: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Appends digest rows as Parquet, exactly once for each archive."""
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
