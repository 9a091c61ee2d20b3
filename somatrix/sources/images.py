"""Micrographs as rows: Spark's image source decodes them, and a relational pixel table comes out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.functions.text import DIMENSIONS, image_dimension


def read_images(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,png,jpg}") -> DataFrame:
    """(path, height, width, channels, data, dimensions...) of the images below ``path``; ``unreadable`` tells which files
    aren't among them. Channels are in the order blue, green, red, alpha."""
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": True, "dropInvalid": True, "ignoreCorruptFiles": True}
    found = spark.read.format("image").options(**options).load(path)
    flat = found.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    name = F.element_at(F.split("path", "/"), -1)
    return flat.withColumns({d: image_dimension(name, d) for d in DIMENSIONS})


def list_images(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,png,jpg}") -> DataFrame:
    """(path, modificationTime, length) of the files that aren't empty, whatever they hold; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", "length")


def unreadable(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,png,jpg}") -> DataFrame:
    """(path, error): one row for each file that matches and can't be decoded, empty ones too, which Spark's sources pass over.
    The driver holds the names, as it does for every scan of files."""
    names = [(name,) for name in list_images(spark, path, pattern).inputFiles()]
    files = spark.createDataFrame(names, "path string")
    return files.join(read_images(spark, path, pattern).select("path"), "path", "left_anti").withColumn("error", F.lit("empty, or not a picture that can be decoded"))


def gray(planes: np.ndarray) -> np.ndarray:
    """(height, width) of an image (height, width, channels): its one channel, or of colours 0.299 red, 0.587 green and 0.114
    blue, a half rounded up."""
    if planes.shape[2] < 3:
        return planes[:, :, 0]
    blue, green, red = (planes[:, :, k].astype(np.uint32) for k in range(3))
    return ((299 * red + 587 * green + 114 * blue + 500) // 1000).astype(np.uint8)


def pixels(images: DataFrame, above: int = 0, invert: bool = True) -> DataFrame:
    """(img, r, c): the pixels whose gray value, inverted where cells are black on white, is over ``above``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                plane = gray(np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], -1))
                r, c = np.nonzero((255 - plane if invert else plane) > above)
                for at in range(0, len(r), 1 << 20):
                    part = slice(at, at + (1 << 20))
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(r[part]), pa.string()), pa.array(r[part].astype(np.int64)), pa.array(c[part].astype(np.int64))], ["img", "r", "c"])

    return images.select("path", "height", "width", "data").mapInArrow(run, "img string, r long, c long")


def channel(images: DataFrame, order: str = "bgra") -> DataFrame:
    """(img, r, c, and one column for each letter of ``order``): every pixel, its channels in the order asked for. Gray
    images repeat their one channel; images without alpha are opaque."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                planes = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], -1)
                have = {"b": 0, "g": min(1, planes.shape[2] - 1), "r": min(2, planes.shape[2] - 1), "a": 3}
                r, c = (x.ravel() for x in np.indices(planes.shape[:2]))
                columns = [planes[:, :, have[x]].ravel() if have[x] < planes.shape[2] else np.full(len(r), 255, np.uint8) for x in order]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(r), pa.string()), pa.array(r.astype(np.int64)), pa.array(c.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in columns)], ["img", "r", "c", *(f"ch_{x}" for x in order)])

    kinds = ", ".join(f"ch_{x} int" for x in order)
    return images.select("path", "height", "width", "data").mapInArrow(run, f"img string, r long, c long, {kinds}")
