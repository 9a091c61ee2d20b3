"""From the foreground of images to one row of features a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatrix.operators import measure, raster
from somatrix.tables import materialise

SKELETON = ("End_Points", "Junctions", "Branches", "Initial_Points", "Total_Branches_Length", "ratio_branches")
BOX_SIZES = (16, 32, 64, 128, 256, 512)


def cell_facts(
    pixels: DataFrame, least: int = 1000, most: int = 24_000_000, iterations: int = 4, frame: int = 10, spur: int = 40, sizes: tuple[int, ...] = BOX_SIZES, first: int = 25, step: int = 10
) -> DataFrame:
    """One row for each cell of the foreground ``pixels`` (img, r, c): img, ``Cell``, ``cell_positions`` and the 34 features
    of the fact table, under its column names, and ``centre_r``, ``centre_c``, ``hull_corners`` in the cell's own coordinates.

    A cell is an 8-connected component of ``least`` to ``most`` pixels; its picture is its bounding box, without pieces of
    other cells. The soma is what ``raster.soma`` finds there; the skeleton is the thinned cell without objects of ``spur``
    pixels or fewer and without the soma; Sholl rings are around the soma's centroid. A cell without a soma has soma
    features of 0 and null in the Sholl columns; one without a skeleton has counts of 0. Fractal_dimension is the slope of
    the published feature, null where all boxes hold the cell. No pixels, no rows.
    """
    labelled = materialise(raster.label_components(pixels.select("img", "r", "c"), 8), "labelled")
    boxes = raster.number_cells(raster.component_stats(labelled), least, most)
    boxes = materialise(boxes.withColumn("key", F.struct("img", "cell")), "boxes")
    size = boxes.select(F.col("key").alias("img"), F.col("height").alias("h"), F.col("width").alias("w"))
    own = labelled.join(boxes.select("img", "label", "key", "top", "left"), ["img", "label"])
    own = materialise(own.select(F.col("key").alias("img"), (F.col("r") - F.col("top")).alias("r"), (F.col("c") - F.col("left")).alias("c")), "own")

    body = materialise(raster.soma(own, size, iterations, frame), "soma")
    thinned = measure.skeletons(own.withColumnRenamed("img", "key")).withColumnRenamed("key", "img")
    thinned = raster.erase_small(raster.label_components(thinned, 8), spur)
    skeleton = materialise(raster.difference(thinned, body), "skeleton")
    classed = materialise(raster.feature_class(skeleton, body, size), "classed")
    branches = raster.skeleton_features(classed).select(F.col("img").alias("key"), *[F.col(n.lower()).alias(n) for n in SKELETON])

    centres = materialise(body.groupBy("img").agg(F.avg("r").alias("r0"), F.avg("c").alias("c0")), "centres")
    reach = raster.sholl_reach(centres, size, first, step).withColumnRenamed("img", "key")
    rings = raster.sholl(skeleton, centres, first, step).withColumnRenamed("img", "key").join(reach, "key").filter("ring < circles")
    crossed = rings.groupBy("key").agg(F.sum("crossings").alias("crossed"))
    slopes = raster.fractal_slope(raster.box_counts(own, sizes)).select(F.col("img").alias("key"), F.col("slope").alias("Fractal_dimension"))

    def measured(of: DataFrame) -> DataFrame:
        return measure.measure(of.select("img.img", "img.cell", "r", "c")).withColumn("key", F.struct("img", "cell"))

    cell, soma = measured(own), measured(body)
    cells = cell.select(
        "key",
        *[F.col(n).alias(f"Cell_{n}") for n in (*measure.CELL_FEATURES, "solidity", "convexity")],
        *[F.col(n).alias(n.replace("hull_", "Convex_Hull_", 1)) for n in measure.HULL_FEATURES],
        *("centre_r", "centre_c", "hull_corners"),
    )
    bodies = soma.select("key", *[F.col(n).alias(f"Soma_{n}") for n in measure.CELL_FEATURES])
    whole = boxes.select("img", "cell", "key", *("top", "left", "height", "width"))
    for part in (bodies, branches, slopes, cells, reach, crossed):
        whole = whole.join(part, "key", "left")
    count = [F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in SKELETON[:-1]]
    box = F.format_string("(%d, %d, %d, %d)", F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    return whole.select(
        "img",
        F.col("cell").cast("int").alias("Cell"),
        box.alias("cell_positions"),
        *[F.coalesce(f"Soma_{n}", F.lit(0.0)).alias(f"Soma_{n}") for n in measure.CELL_FEATURES],
        *count,
        SKELETON[-1],
        *[f"Convex_Hull_{n}" for n in ("area", "perimeter", "compactness")],
        "Fractal_dimension",
        *[f"Convex_Hull_{n}" for n in ("eccentricity", "feret_diameter", "orientation")],
        *[f"Cell_{n}" for n in measure.CELL_FEATURES],
        F.col("max_distance").alias("Sholl_max_distance"),
        F.when(F.col("max_distance").isNotNull(), F.coalesce("crossed", F.lit(0))).cast("int").alias("Sholl_crossing_processes"),
        F.col("circles").cast("int").alias("Sholl_circles"),
        *("Cell_solidity", "Cell_convexity"),
        *("centre_r", "centre_c", "hull_corners"),
    )
