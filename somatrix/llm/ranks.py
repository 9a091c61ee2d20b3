"""Exact ranks inside groups by hierarchical histograms of a key's digits: no global sort, no task with a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.tables import materialise

#: Bits of a digit. A cell of the finest histogram spans this many bits of the key.
DIGIT = 12
#: Rows of a cell from which repeated keys are told apart by further digits.
CROWDED = 4 << DIGIT


def group_key(value: Column) -> Column:
    """A text that is never null, different for null and for every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _descend(counts: DataFrame, path: list[str], start: DataFrame, known: int) -> DataFrame:
    """``counts`` (path, n) with ``base``: the rows of the group that come before the node. ``start`` has the first
    ``known`` columns of the path and their base. Each window is one node's children: at most one for each digit."""
    levels = [counts]
    for depth in range(len(path) - 1, known, -1):
        levels.append(levels[-1].groupBy(*path[:depth]).agg(F.sum("n").alias("n")))
    above = start.select(*path[:known], F.col("base").alias("before"))
    for depth, level in zip(range(known + 1, len(path) + 1), reversed(levels), strict=True):
        order = Window.partitionBy(*path[: depth - 1]).orderBy(F.col(path[depth - 1])).rowsBetween(Window.unboundedPreceding, -1)
        inside = level.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0)))
        joined = inside.join(above, path[: depth - 1]).withColumn("base", F.col("before") + F.col("inside")).drop("before", "inside")
        above = joined.select(*path[:depth], F.col("base").alias("before"))
    return joined


def ranked(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 inside each value of ``group``, by ``key`` (integer, null first), then ``tie``
    (text, no null), and ``total``, the rows of the group. ``group`` holds no null (see ``group_key``).

    Rows are counted by cells of 4,096 successive keys; the counts are summed over coarser and coarser digits, as many
    as the keys' span needs, and running sums descend again, each over the children of one node. Only a cell's own rows
    are sorted together. Cells of more than 16,384 rows, which only repeated keys make, are split by key, by three and
    six characters of the tie, by the tie and by the stored file's part; rows that agree in all of it are
    interchangeable. An empty table gives no rows. Columns beginning with ``digit_`` are used inside.
    """
    names = rows.columns
    lowest = -(1 << (63 - DIGIT)) - 1  # the cell of null keys
    cell = F.coalesce(F.shiftright(F.col(key).cast("long"), DIGIT), F.lit(lowest))
    stored = materialise(rows.withColumn("digit_cell", cell).withColumn("digit_part", F.spark_partition_id()), "ranked")
    cells = materialise(stored.groupBy(group, "digit_cell").agg(F.count("*").alias("n")), "cells")
    low, high = cells.agg(F.min("digit_cell"), F.max("digit_cell")).first()
    coarser: list[str] = []  # until the top has no more nodes than a digit has values
    while low is not None and (high >> DIGIT * len(coarser)) - (low >> DIGIT * len(coarser)) >> DIGIT:
        coarser.append(f"digit_{len(coarser) + 1}")
    counts = cells.select(group, *[F.shiftright("digit_cell", DIGIT * (k + 1)).alias(c) for k, c in reversed(list(enumerate(coarser)))], "digit_cell", "n")
    totals = cells.groupBy(group).agg(F.sum("n").alias("total")).withColumn("base", F.lit(0).cast("long"))
    based = _descend(counts, [group, *reversed(coarser), "digit_cell"], totals, 1).select(group, "digit_cell", "n", "base")
    based = based.join(totals.drop("base"), group)

    crowded = cells.filter(F.col("n") > CROWDED).select(group, "digit_cell")
    some = not crowded.isEmpty()
    order = Window.partitionBy(group, "digit_cell").orderBy(F.col(key).asc_nulls_first(), tie)
    plain = stored.join(crowded, [group, "digit_cell"], "left_anti") if some else stored
    plain = plain.withColumn("digit_row", F.row_number().over(order) - 1).join(based, [group, "digit_cell"])
    out = plain.select(*names, (F.col("base") + F.col("digit_row")).alias("rank"), "total")
    if not some:
        return out

    path = [group, "digit_cell", "digit_key", "digit_t3", "digit_t6", "digit_tie", "digit_part"]
    split = stored.join(crowded, [group, "digit_cell"], "left_semi")
    split = split.withColumns({"digit_key": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "digit_tie": F.col(tie)})
    split = split.withColumns({"digit_t3": F.substring(tie, 1, 3), "digit_t6": F.substring(tie, 1, 6)})
    finest = materialise(split.groupBy(*path).agg(F.count("*").alias("n")), "crowded")
    own = _descend(finest, path, based, 2).select(*path, "base").join(based.select(group, "digit_cell", "total"), [group, "digit_cell"])
    alike = Window.partitionBy(*path).orderBy(F.lit(0))  # rows of one stored part at most
    split = split.withColumn("digit_row", F.row_number().over(alike) - 1).join(own, path)
    return out.unionByName(split.select(*names, (F.col("base") + F.col("digit_row")).alias("rank"), "total"))
