"""Column functions for names, keys and texts of tuples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: {subject}_{group}_{treatment}_{tissue}_{region}, with or without the suffix of processed files, and an extension.
IMAGE_NAME = r"([^_/]+)_([^_/]+)_([^_/]+)_([^_/]+)_([^_/.]+?)(?:_FOTO1_PROCESSED)?\.(tiff?|png|jpg)$"
DIMENSIONS = ("subject", "group", "treatment", "tissue", "region")
#: Extensions in order of precedence.
EXTENSIONS = (".tif", ".tiff", ".png", ".jpg")


def image_dimension(name: Column, dimension: str) -> Column:
    """One of the five dimensions in an image's name; null where the name is of another form."""
    found = F.regexp_extract(name, IMAGE_NAME, DIMENSIONS.index(dimension) + 1)
    return F.when(found != "", found)


def image_name(subject: Column, group: Column, treatment: Column, tissue: Column, region: Column, processed: bool = False, extension: str = EXTENSIONS[0]) -> Column:
    """The image's name from its dimensions; null if any is null."""
    ending = F.lit(("_FOTO1_PROCESSED" if processed else "") + extension)
    return F.concat(subject, F.lit("_"), group, F.lit("_"), treatment, F.lit("_"), tissue, F.lit("_"), region, ending)


def first_number(text: Column) -> Column:
    """The first run of digits, as an integer; null without digits."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def cell_number(name: Column) -> Column:
    """The number after the last ``_cell_``, up to the dot."""
    return F.split_part(F.element_at(F.split(name, "_cell_"), -1), F.lit("."), F.lit(1)).try_cast("int")


def box_from_text(text: Column) -> Column:
    """(x1, y1, x2, y2) from text such as ``(10, 20, 45, 78)``; fails on anything else, and never evaluates it."""
    form = r"^\(\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*\)$"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))
    box = F.struct(*[numbers[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(form), box).otherwise(F.raise_error(F.concat(F.lit("not a box: "), text)))


def colour_text(r: Column, g: Column, b: Column) -> Column:
    return F.concat_ws(",", r.cast("string"), g.cast("string"), b.cast("string"))


def colour_from_text(text: Column) -> Column:
    """[r, g, b] from ``r,g,b`` with or without parentheses."""
    return F.transform(F.split(F.regexp_replace(text, r"^\(|\)$", ""), ","), lambda x: F.trim(x).cast("int"))


def listed(text: Column) -> Column:
    """The trimmed values of a comma list."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def without_extension(name: Column) -> Column:
    """All but the last four characters."""
    return F.left(name, F.greatest(F.length(name) - 4, F.lit(0)))


def extension_rank(extension: Column) -> Column:
    """Place in ``EXTENSIONS``, 0 first; null for others."""
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.lower(extension)) - 1
    return F.when(rank >= 0, rank)


def cell_id(order: str = "region") -> Column:
    """``C{cell}_...`` from columns cell and the dimensions, region first or subject first; null if any is null."""
    parts = {"region": ("region", "group", "treatment", "tissue", "subject"), "subject": ("subject", "group", "treatment", "tissue", "region")}[order]
    whole = F.concat(F.lit("C"), F.col("cell").cast("string"))
    for p in parts:
        whole = F.concat(whole, F.lit("_"), F.col(p))
    return whole


def category() -> Column:
    return F.concat("group", F.lit("_"), "treatment", F.lit("_"), "region")
