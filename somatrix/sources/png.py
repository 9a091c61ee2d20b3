"""Pixel tables as images, and what is drawn over them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somatrix.sources.files import encode_tiff

#: Colour types of the format, by number of channels.
COLOUR_TYPE = {1: 0, 3: 2, 4: 6}
#: Digits 0 to 9, in five lines of three dots.
GLYPHS = (
    "### #.# #.# #.# ###", ".#. ##. .#. .#. ###", "### ..# ### #.. ###", "### ..# ### ..# ###", "#.# #.# ### ..# ..#",
    "### #.. ### ..# ###", "### #.. ### #.# ###", "### ..# .#. .#. .#.", "### #.# ### #.# ###", "### #.# ### ..# ###",
)
#: Pixels of an image that one task draws at most.
MOST_PIXELS = 400_000_000


def encode(image: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, channels) of bytes: gray, or red, green, blue, with or without alpha."""
    height, width, channels = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * channels)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def draw(pixels: DataFrame, size: DataFrame, background: tuple[int, int, int, int] = (0, 0, 0, 0), kind: str = "png") -> DataFrame:
    """(img, png), or (img, tif) if ``kind`` says so, from pixels (img, r, c, colour), colour being text ``r,g,b``, and sizes (img, h, w). Each image is drawn
    in one task; pixels outside it are left out, and of pixels that repeat, the last colour in order of text is on top.
    Images without pixels are all background."""
    kinds = dict(size.dtypes)
    rows = size.join(pixels.select("img", "r", "c", "colour"), "img", "left").select("img", "h", "w", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "colour")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        h, w = int(frame["h"].iloc[0]), int(frame["w"].iloc[0])
        if h * w > MOST_PIXELS:
            raise ValueError(f"an image of {h} by {w} pixels is drawn in tiles, not whole")
        canvas = np.empty((h, w, 4), np.uint8)
        canvas[:] = background
        inside = frame[frame["r"].between(0, h - 1) & frame["c"].between(0, w - 1)].sort_values("colour", kind="stable")
        if len(inside):
            colours = np.array([[int(x) for x in t.split(",")] for t in inside["colour"]], np.uint8)
            at = inside["r"].to_numpy(int), inside["c"].to_numpy(int)
            canvas[at[0], at[1], :3], canvas[at[0], at[1], 3] = colours, 255
        return pd.DataFrame({"img": [frame["img"].iloc[0]], kind: [{"png": encode, "tif": encode_tiff}[kind](canvas)]})

    return rows.groupBy("img").applyInPandas(one, f"img {kinds['img']}, {kind} binary")


def coloured_crops(cells: DataFrame, boxes: DataFrame, colours: DataFrame, kind: str = "tif") -> DataFrame:
    """(name, content): a picture of each cell of ``boxes`` (img, cell, top, left, height, width), ``<img>_cell_<cell>.<kind>``,
    with its pixels of ``cells`` (img, cell, r, c, in the image's coordinates) in its colour of ``colours`` (img, cell, colour
    as ``r,g,b``), gray where it has none, and transparent elsewhere."""
    name = F.concat(F.col("img").cast("string"), F.lit("_cell_"), F.col("cell").cast("string"), F.lit(f".{kind}"))
    framed = boxes.join(colours, ["img", "cell"], "left").select("img", "cell", "top", "left", "height", "width", F.coalesce("colour", F.lit("128,128,128")).alias("colour"))
    placed = cells.join(framed, ["img", "cell"]).select(name.alias("img"), (F.col("r") - F.col("top")).alias("r"), (F.col("c") - F.col("left")).alias("c"), "colour")
    size = boxes.select(name.alias("img"), F.col("height").alias("h"), F.col("width").alias("w"))
    return draw(placed, size, kind=kind).select(F.col("img").alias("name"), F.col(kind).alias("content"))


def numbers(boxes: DataFrame, scale: int = 2) -> DataFrame:
    """(img, r, c, colour): the numbers of cells (img, cell, top, left, colour) in digits of 3 by 5 dots, each ``scale`` pixels
    wide, from the upper left corner of the box inwards. Digits may reach beyond the image, where ``draw`` leaves them out."""
    dots = [(str(d), at // 3, at % 3) for d, glyph in enumerate(GLYPHS) for at, dot in enumerate(glyph.replace(" ", "")) if dot == "#"]
    table = boxes.sparkSession.createDataFrame(dots, "digit string, dot_r int, dot_c int")  # ten glyphs of fifteen dots at most
    digits = F.posexplode(F.split(F.col("cell").cast("string"), "(?!^)"))
    text = boxes.select("img", "top", "left", "colour", digits.alias("place", "digit")).join(F.broadcast(table), "digit")
    fill = text.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(scale - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))))
    r = F.col("top") + 2 + F.col("dot_r") * scale + F.col("i")
    c = F.col("left") + 2 + (F.col("place") * 4 + F.col("dot_c")) * scale + F.col("j")
    return fill.select("img", r.alias("r"), c.alias("c"), "colour")


def annotations(boxes: DataFrame) -> DataFrame:
    """(img, r, c, colour): the outlines of boxes (img, top, left, height, width, colour), to be drawn over an image."""
    rows = F.sequence(F.col("top"), F.col("top") + F.col("height") - 1)
    columns = F.sequence(F.col("left"), F.col("left") + F.col("width") - 1)
    right, bottom = F.col("left") + F.col("width") - 1, F.col("top") + F.col("height") - 1

    def upright(c: Column) -> Column:
        return F.transform(rows, lambda r: F.struct(r.alias("r"), c.alias("c")))

    def level(r: Column) -> Column:
        return F.transform(columns, lambda c: F.struct(r.alias("r"), c.alias("c")))

    sides = [upright(F.col("left")), upright(right), level(F.col("top")), level(bottom)]
    return boxes.select("img", "colour", F.explode(F.array_distinct(F.concat(*sides))).alias("p")).select("img", "p.r", "p.c", "colour")
