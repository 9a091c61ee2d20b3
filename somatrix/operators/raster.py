"""Operators on pixel sets.

A pixel set is a table (img, r, c), one row for each foreground pixel: images of any size and number in one table, keyed
by ``img``. Neighbourhoods are equi-joins over exploded offsets, so they shuffle by pixel and never pair rows of an image.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.operators.graph import components
from somatrix.tables import materialise

FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)
#: Side of the squares in which components are labelled before they are joined over the squares' borders.
TILE = 512


def offsets(pairs: tuple[tuple[int, int], ...]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in pairs]))


def square(radius: int) -> tuple[tuple[int, int], ...]:
    return tuple((dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1))


def shifted(pixels: DataFrame, pairs: tuple[tuple[int, int], ...]) -> DataFrame:
    """Every pixel moved by every offset; repeats stay."""
    return pixels.select("img", "r", "c", offsets(pairs).alias("o")).select("img", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))


def extent(pixels: DataFrame) -> DataFrame:
    """(img, h, w) of the images that a table of all their pixels describes."""
    return pixels.groupBy("img").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def neighbour_count(pixels: DataFrame) -> DataFrame:
    """(img, r, c, n): the foreground pixels among each foreground pixel's eight neighbours."""
    votes = shifted(pixels, EIGHT).groupBy("img", "r", "c").agg(F.count("*").alias("n"))
    return pixels.join(votes, ["img", "r", "c"], "left").select("img", "r", "c", F.coalesce("n", F.lit(0)).alias("n"))


def neighbour_class(pixels: DataFrame) -> DataFrame:
    """(img, r, c, n, kind) of skeleton pixels: end (one neighbour), path (two), junction (three or more), isolated."""
    kind = F.when(F.col("n") == 1, "end").when(F.col("n") == 2, "path").when(F.col("n") >= 3, "junction").otherwise("isolated")
    return neighbour_count(pixels).withColumn("kind", kind)


def line(radius: int, down: bool) -> tuple[tuple[int, int], ...]:
    return tuple((d, 0) if down else (0, d) for d in range(-radius, radius + 1))


def erode(pixels: DataFrame, size: DataFrame, iterations: int = 1) -> DataFrame:
    """Pixels whose window of 2 * iterations + 1 holds foreground alone; outside the image nothing erodes. A square window
    is a row's and then a column's: each pass moves a pixel 2 * iterations + 1 times."""
    k = iterations
    left = pixels.select("img", "r", "c")
    for down, at, edge in ((False, "c", "w"), (True, "r", "h")):
        votes = shifted(left, line(k, down)).groupBy("img", "r", "c").agg(F.count("*").alias("n")).join(size, "img")
        inside = F.least(F.col(edge) - 1, F.col(at) + k) - F.greatest(F.lit(0), F.col(at) - k) + 1
        kept = (F.col("n") == inside) & F.col(at).between(0, F.col(edge) - 1)
        left = votes.filter(kept).select("img", "r", "c")
    return left


def dilate(pixels: DataFrame, size: DataFrame, iterations: int = 1) -> DataFrame:
    """All pixels within ``iterations`` rows and columns of a foreground pixel, inside the image; by rows, then columns."""
    wide = shifted(pixels, line(iterations, False)).distinct()
    moved = shifted(wide, line(iterations, True)).distinct().join(size, "img")
    return moved.filter((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("h")) & (F.col("c") < F.col("w"))).select("img", "r", "c")


def label_square(frame: pd.DataFrame, eight: bool) -> np.ndarray:
    """For the pixels of one square: the row of the first pixel, in row and column order, of each one's component."""
    order = np.lexsort((frame["c"].to_numpy(), frame["r"].to_numpy()))
    r, c = frame["r"].to_numpy()[order].astype(np.int64), frame["c"].to_numpy()[order].astype(np.int64)
    width = c.max() + 3
    code = r * width + c
    root = np.arange(len(code))
    steps = [(0, -1), (-1, 0), *([(-1, -1), (-1, 1)] if eight else [])]
    pairs = []
    for dr, dc in steps:
        want = code + dr * width + dc
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        hit = np.flatnonzero((code[at] == want) & (c + dc >= 0))
        pairs.append((hit, at[hit]))
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    while True:  # every root hooks to the least root beside it, then all paths are halved
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    out = np.empty(len(code), np.int64)
    out[order] = order[root]
    return out


def label_components(pixels: DataFrame, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """(img, r, c, label): label is the code of the component's first pixel, rows from the top, each from the left.

    Squares of ``tile`` by ``tile`` are labelled by themselves; where components touch over a border, the squares' labels
    are links of a graph whose components are the image's. No task sees more than a square, or more than links.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    schema = f"img {dict(pixels.dtypes)['img']}, r long, c long, local long"

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[label_square(frame, connectivity == 8)]
        return pd.DataFrame({"img": frame["img"], "r": frame["r"], "c": frame["c"], "local": first["r"].to_numpy() * (1 << 31) + first["c"].to_numpy()})

    keyed = pixels.select("img", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    squares = keyed.groupBy("img", F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    labelled = materialise(squares.applyInPandas(label, schema), "squares")  # read three times below
    edge = labelled.filter((F.col("r") % tile == 0) | (F.col("r") % tile == tile - 1) | (F.col("c") % tile == 0) | (F.col("c") % tile == tile - 1))
    pairs = EIGHT if connectivity == 8 else FOUR
    moved = edge.select("img", "r", "c", "local", offsets(pairs).alias("o"))
    moved = moved.select("img", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("local").alias("other"))
    touching = edge.join(moved, ["img", "r", "c"]).filter("local != other")
    links = materialise(touching.select(F.struct("img", "local").alias("a"), F.struct("img", F.col("other").alias("local")).alias("b")).distinct(), "touching")
    if links.isEmpty():
        return labelled.withColumnRenamed("local", "label")
    roots = components(links).select(F.col("node.img").alias("img"), F.col("node.local").alias("local"), F.col("root.local").alias("label"))
    return labelled.join(roots, ["img", "local"], "left").select("img", "r", "c", F.coalesce("label", "local").alias("label"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """(img, label, area, top, left, height, width, cr, cc): size, bounding box and centroid of each component."""
    return labelled.groupBy("img", "label").agg(
        F.count("*").alias("area"),
        F.min("r").alias("top"),
        F.min("c").alias("left"),
        (F.max("r") - F.min("r") + 1).alias("height"),
        (F.max("c") - F.min("c") + 1).alias("width"),
        F.avg("r").alias("cr"),
        F.avg("c").alias("cc"),
    )


def number_cells(stats: DataFrame, least: int = 1000, most: int = 24_000_000) -> DataFrame:
    """The components with an area from ``least`` to ``most``, numbered from 1 in label order (column ``cell``)."""
    kept = stats.filter(F.col("area").between(least, most))
    return kept.withColumn("cell", F.row_number().over(Window.partitionBy("img").orderBy("label")))


def crops(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(img, cell, r, c): the pixels inside each cell's bounding box, counted from its corner; pieces of neighbours too.

    ``boxes`` is (img, cell, top, left, height, width). The band join runs over cells of a grid as wide as a tile."""
    step = F.lit(TILE)
    rows = F.sequence(F.floor(F.col("top") / step), F.floor((F.col("top") + F.col("height") - 1) / step))
    cols = F.sequence(F.floor(F.col("left") / step), F.floor((F.col("left") + F.col("width") - 1) / step))
    spread = boxes.withColumn("gr", F.explode(rows)).withColumn("gc", F.explode(cols))
    near = pixels.withColumn("gr", F.floor(F.col("r") / step)).withColumn("gc", F.floor(F.col("c") / step)).join(spread, ["img", "gr", "gc"])
    inside = near.filter((F.col("r") >= F.col("top")) & (F.col("r") < F.col("top") + F.col("height")) & (F.col("c") >= F.col("left")) & (F.col("c") < F.col("left") + F.col("width")))
    return inside.select("img", "cell", (F.col("r") - F.col("top")).alias("r"), (F.col("c") - F.col("left")).alias("c"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """The pixels of each image's largest component; of equal ones, the one with the first pixel."""
    sizes = labelled.groupBy("img", "label").agg(F.count("*").alias("area"))
    best = sizes.groupBy("img").agg(F.max_by("label", F.struct("area", (-F.col("label")).alias("first"))).alias("label"))
    return labelled.join(best, ["img", "label"], "left_semi").select("img", "r", "c")


def erase_small(labelled: DataFrame, most: int = 40) -> DataFrame:
    """The pixels of components of more than ``most`` pixels."""
    kept = labelled.groupBy("img", "label").agg(F.count("*").alias("area")).filter(F.col("area") > most)
    return labelled.join(kept, ["img", "label"], "left_semi").select("img", "r", "c")


def soma(pixels: DataFrame, size: DataFrame, iterations: int = 4, frame: int = 10) -> DataFrame:
    """Erosion, the largest remaining component, dilation, and nothing within ``frame`` pixels of the image's border."""
    core = largest_component(label_components(erode(pixels, size, iterations)))
    grown = dilate(core, size, iterations).join(size, "img")
    inside = F.col("r").between(frame, F.col("h") - frame - 1) & F.col("c").between(frame, F.col("w") - frame - 1)
    return grown.filter(inside).select("img", "r", "c")


def feature_class(skeleton: DataFrame, body: DataFrame, size: DataFrame) -> DataFrame:
    """``neighbour_class`` of the skeleton, in which pixels that touch the body are of kind initial, whatever else."""
    band = dilate(body, size, 1).withColumn("touch", F.lit(True))
    return neighbour_class(skeleton).join(band, ["img", "r", "c"], "left").withColumn("kind", F.when(F.col("touch"), "initial").otherwise(F.col("kind"))).drop("touch")


def skeleton_features(classed: DataFrame) -> DataFrame:
    """Counts of objects for each image: end points, junctions, branches, initial points. The column named
    total_branches_length is a count too: objects of path pixels joined by edges, plus end points."""

    keyed = classed.select(F.struct("img", "kind").alias("img"), "r", "c")  # kinds of one image are labelled apart, at once
    edges = label_components(keyed.filter("img.kind in ('end', 'junction', 'initial', 'path')"), 4)
    corners = label_components(keyed.filter("img.kind = 'path'"), 8).withColumn("img", F.struct("img.img", F.lit("branch").alias("kind")))
    counted = edges.unionByName(corners).groupBy("img").agg(F.countDistinct("label").alias("n")).select("img.img", "img.kind", "n")
    names = {"end": "end_points", "junction": "junctions", "branch": "branches", "initial": "initial_points", "path": "path_objects"}
    wide = counted.groupBy("img").agg(*[F.max(F.when(F.col("kind") == kind, F.col("n"))).alias(name) for kind, name in names.items()])
    whole = classed.select("img").distinct().join(wide, "img", "left").na.fill(0, list(names.values()))
    return whole.withColumn("total_branches_length", F.col("path_objects") + F.col("end_points")).drop("path_objects").withColumn("ratio_branches", F.try_divide(F.col("end_points"), F.col("initial_points")))


def box_counts(pixels: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(img, size, n): boxes of a grid from the corner that hold foreground, for each side length."""
    each = pixels.select("img", "r", "c", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    boxes = each.select("img", "size", F.floor(F.col("r") / F.col("size")).alias("br"), F.floor(F.col("c") / F.col("size")).alias("bc")).distinct()
    return boxes.groupBy("img", "size").agg(F.count("*").alias("n"))


def fractal_slope(counts: DataFrame) -> DataFrame:
    """(img, slope): of log count on log size. The published feature is this slope, below zero, not the dimension."""
    return counts.groupBy("img").agg(F.regr_slope(F.ln("n"), F.ln("size")).alias("slope"))


def sholl(pixels: DataFrame, centres: DataFrame, first: int, step: int, half_width: float = 1.0) -> DataFrame:
    """(img, ring, pixels, crossings): foreground on rings around each image's centre (img, r0, c0), and the number of
    8-connected objects on each ring."""
    d = F.hypot(F.col("r") - F.col("r0"), F.col("c") - F.col("c0"))
    ring = F.floor((F.col("d") - first) / step + 0.5)
    near = pixels.join(F.broadcast(centres) if centres.count() < 10_000 else centres, "img").withColumn("d", d).withColumn("ring", ring)
    on = near.filter((F.col("ring") >= 0) & (F.abs(F.col("d") - (first + step * F.col("ring"))) <= half_width))
    objects = label_components(on.select(F.struct("img", "ring").alias("img"), "r", "c"))
    counted = objects.groupBy("img").agg(F.count("*").alias("pixels"), F.countDistinct("label").alias("crossings"))
    return counted.select("img.img", "img.ring", "pixels", "crossings")


def sholl_reach(centres: DataFrame, size: DataFrame, first: int = 25, step: int = 10) -> DataFrame:
    """(img, max_distance, circles): distance to the farthest corner, and the number of rings below it."""
    far = F.greatest(*[F.hypot(F.col("r0") - r, F.col("c0") - c) for r in (F.lit(0), F.col("h")) for c in (F.lit(0), F.col("w"))])
    whole = centres.join(size, "img").withColumn("max_distance", far)
    rings = F.greatest(F.lit(0), F.ceil((F.floor("max_distance") - first) / step))
    return whole.select("img", "max_distance", rings.alias("circles"))


def overlay(layers: DataFrame) -> DataFrame:
    """(img, r, c, colour): of several layers (img, r, c, cell, colour), the pixel of the largest cell is on top."""
    return layers.groupBy("img", "r", "c").agg(F.max_by("colour", "cell").alias("colour"))


def blend(layers: DataFrame, old: str, new: str, alpha: float = 0.3) -> DataFrame:
    """Weighted mean of two channel columns of whole numbers, rounded half to even: ``blended``.

    Weights are decimals, so a half is a half. The published call works in binary fractions of a width that depends on the
    build, beside which halves fall either way."""
    weight = Decimal(str(alpha))
    mean = F.lit(weight) * F.col(old).cast("decimal(9,0)") + F.lit(1 - weight) * F.col(new).cast("decimal(9,0)")
    return layers.withColumn("blended", F.bround(mean).cast("int"))


def alpha_of(pixels: DataFrame, background: str = "transparent") -> DataFrame:
    """``alpha`` for pixels (b, g, r): 0 on black, 255 elsewhere; 255 everywhere on an opaque background."""
    black = (F.col("b") == 0) & (F.col("g") == 0) & (F.col("r") == 0)
    return pixels.withColumn("alpha", F.lit(255) if background == "black" else F.when(black, 0).otherwise(255))


def strips(boxes: DataFrame) -> DataFrame:
    """Boxes (img, cluster, cell, height, width) with ``offset``, where each starts in its cluster's strip, and
    ``padded``, the strip's height over all of the image's clusters."""
    before = Window.partitionBy("img", "cluster").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    tallest = boxes.groupBy("img").agg(F.max("height").alias("padded"))
    return boxes.withColumn("offset", F.coalesce(F.sum("width").over(before), F.lit(0))).join(tallest, "img")


def colour_masks(pixels: DataFrame, ranges: dict[str, tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]) -> DataFrame:
    """(img, r, c, mask) of pixels (img, r, c, blue, green, red): each mask in whose ranges, ends included, they lie."""
    named = [F.when(F.col("blue").between(*b) & F.col("green").between(*g) & F.col("red").between(*r), F.lit(name)) for name, (b, g, r) in ranges.items()]
    return pixels.select("img", "r", "c", F.explode(F.array_compact(F.array(*named))).alias("mask"))


def rainbow(position: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1 at a place from 0 to 1 of the published rainbow, violet to red: straight-line red
    |2x - 1/2|, kept within 0 and 1, a half sine of green, and a quarter cosine of blue."""
    red = F.least(F.greatest(F.abs(2 * position - 0.5), F.lit(0.0)), F.lit(1.0))
    return red, F.sin(F.lit(3.141592653589793) * position), F.cos(F.lit(3.141592653589793) / 2 * position)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["img", "r", "c"], "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["img", "r", "c"], "left_semi")


def pad(pixels: DataFrame, rows: int, columns: int) -> DataFrame:
    """A border of empty rows and columns: coordinates move, nothing else."""
    return pixels.withColumn("r", F.col("r") + rows).withColumn("c", F.col("c") + columns)


def gamma(value: Column, exponent: float) -> Column:
    """Gamma correction of a value from 0 to 255, truncated."""
    return F.floor(F.pow(value / 255, F.lit(exponent)) * 255).cast("int")
