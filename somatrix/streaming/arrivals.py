"""Facts from a folder in which files arrive. The reference processes a folder once; these are extensions to that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.functions.text import DIMENSIONS, image_dimension


def stream_parquet(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Rows of the parquet files that arrive in ``path``, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_images(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,png,jpg}", files: int = 100) -> DataFrame:
    """(path, modificationTime, value, dimensions...) of image files as they arrive below ``path``, ``value`` being their
    length: at most ``files`` a batch. Each file counts once, by name; contents aren't decoded."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files)
    found = source.load(path).select("path", "modificationTime", F.col("length").alias("value"))
    name = F.element_at(F.split("path", "/"), -1)
    return found.withColumns({d: image_dimension(name, d) for d in DIMENSIONS})


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, end, by, n, total): counts and sums of ``value`` in windows of event time; later rows than ``late`` go."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = timed.groupBy(F.window(time, width, slide or width), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, by, n): runs of one key's rows that lie less than ``gap`` apart."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = timed.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch to parquet, exactly once; all that is there, then end."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
