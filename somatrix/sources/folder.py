"""From a folder of micrographs to the fact table, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.functions.text import DIMENSIONS, category, cell_id
from somatrix.operators.cells import cell_facts
from somatrix.sources import images
from somatrix.tables import materialise


def folder_facts(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff,png,jpg}", above: int = 0, invert: bool = True, order: str = "region", **options) -> DataFrame:
    """One row for each cell of the images below ``path``: ``Cell_ID``, ``image``, ``file``, the five dimensions of the name,
    ``categories``, then what ``cells.cell_facts`` measures; ``options`` go there.

    Foreground is where the gray value (inverted, where cells are dark on light) is over ``above``. A name of another form
    leaves dimensions, Cell_ID and categories null; its cells stay. Files that can't be decoded have no rows here;
    ``images.unreadable`` lists them. Images are decoded once for pixels, once for their names; no images, no rows."""
    found = images.read_images(spark, path, pattern)
    foreground = materialise(images.pixels(found, above, invert), "foreground")
    measured = cell_facts(foreground, **options)
    names = found.select(F.col("path").alias("img"), *DIMENSIONS)
    whole = measured.join(names, "img").withColumn("cell", F.col("Cell"))
    named = whole.select(
        cell_id(order).alias("Cell_ID"),
        F.element_at(F.split("img", "/"), -1).alias("image"),
        F.col("img").alias("file"),
        *DIMENSIONS,
        category().alias("categories"),
        *[c for c in measured.columns if c != "img"],
    )
    return named
