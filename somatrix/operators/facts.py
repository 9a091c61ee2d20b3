"""From feature tables to the fact table, and its recodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.functions.shape import ratio
from somatrix.functions.text import DIMENSIONS, category, cell_id, extension_rank
from somatrix.tables import free_names, materialise

#: Rows of a dimension table that are sent to every executor at most; larger ones are joined by shuffle.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def join_features(tables: list[DataFrame], keys: tuple[str, ...] = ("img", "cell")) -> DataFrame:
    """Inner join of feature tables on ``keys``: a cell that any of them lacks goes. One partitioning serves all joins."""
    return reduce(lambda a, b: a.join(b, list(keys)), tables)


def with_ratios(facts: DataFrame, ieee: bool = False) -> DataFrame:
    """Solidity, convexity and the branch ratio, where their columns are there."""
    for name, a, b in (("cell_solidity", "cell_area", "convex_hull_area"), ("cell_convexity", "cell_perimeter", "convex_hull_perimeter"), ("ratio_branches", "end_points", "initial_points")):
        if a in facts.columns and b in facts.columns:
            facts = facts.withColumn(name, ratio(F.col(a), F.col(b), ieee))
    return facts


def with_keys(facts: DataFrame, order: str = "region") -> DataFrame:
    """``categories`` and ``cell_id`` from the dimensions, as first columns."""
    keyed = facts.withColumn("categories", category()).withColumn("cell_id", cell_id(order))
    return to_front(keyed, ["categories", "cell_id"])


def to_front(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def feature_columns(df: DataFrame, start: int = 10, without: tuple[str, ...] = ("_orientation",), without_prefix: tuple[str, ...] = ("UMAP_",)) -> list[str]:
    """The columns from position ``start`` whose names lack these parts and prefixes."""
    return [c for c in df.columns[start:] if not any(x in c for x in without) and not c.startswith(without_prefix)]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def spaced_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("_", " ") for c in df.columns])


def recode(df: DataFrame, column: str, mapping: DataFrame, unmatched: str = "keep", to: str | None = None) -> DataFrame:
    """``column`` by ``mapping`` (old, new). Values that it lacks are kept, or null, or a default: ``unmatched`` is keep,
    null, or a column. Of repeated old values the mapping's least new one counts."""
    before, after = free_names(df, "old", "new")
    one = mapping.groupBy(F.col("old").alias(before)).agg(F.min("new").alias(after))
    joined = df.join(small(one), df[column] == one[before], "left")
    new = F.col(after)
    if unmatched == "keep":
        new = F.coalesce(new, F.col(column))
    elif isinstance(unmatched, Column):
        new = F.coalesce(new, unmatched)
    return joined.withColumn(to or column, new).drop(before, after)


def without_noise(facts: DataFrame, column: str = "cluster") -> DataFrame:
    return facts.filter(F.col(column) != -1)


def matching(facts: DataFrame, combinations: DataFrame) -> DataFrame:
    """Facts whose dimensions are among ``combinations``: a semi-join in place of a filter for each one."""
    return facts.join(small(combinations.distinct()), list(combinations.columns), "left_semi")


def probe_names(files: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Files whose parsed dimensions each are in the dimension's list (a table with that one column). One listing and a
    semi-join for each dimension stand for a probe of every combination."""
    for name in DIMENSIONS:
        if name in dimensions:
            files = files.join(small(dimensions[name].distinct()), name, "left_semi")
    return files


def first_extension(files: DataFrame) -> DataFrame:
    """Of files (base, extension, ...) with one base, the one whose extension comes first; others' extensions go."""
    ranked = files.withColumn("rank", extension_rank(F.col("extension"))).filter("rank is not null")
    order = Window.partitionBy("base").orderBy("rank", F.xxhash64(*files.columns))
    return ranked.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def colour_dimension(rows: DataFrame) -> DataFrame:
    """(cluster, colour): each cluster's colour in its last row, by ``cell``."""
    return rows.groupBy("cluster").agg(F.max_by("colour", "cell").alias("colour"))


def with_colours(facts: DataFrame, colours: DataFrame, default: str = "128,128,128") -> DataFrame:
    one = colours.groupBy("cluster").agg(F.min("colour").alias("colour"))
    return facts.join(small(one), "cluster", "left").withColumn("colour", F.coalesce("colour", F.lit(default)))


def highlight(facts: DataFrame, column: str, value, name: str = "highlight") -> DataFrame:
    return facts.withColumn(name, F.coalesce(F.col(column) == value, F.lit(False)))


def by_name(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Attach results by key, never by row order."""
    return df.join(values, key, "left")


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images (img, h, w) whose size is the same in both tables; the others can't be compared pixel by pixel."""
    return a.join(b, ["img", "h", "w"], "left_semi")


def transposed(df: DataFrame, key: str, values: list) -> DataFrame:
    """(feature, one column for each of ``values``): rows become columns, named after ``key``."""
    features = [c for c in df.columns if c != key]
    long = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "value")
    return long.groupBy("feature").pivot(key, values).agg(F.first("value"))


def numbered(df: DataFrame, by: str, place: str = "place") -> DataFrame:
    """``df`` sorted by a column, null first, with each row's ``place``, from 1: rows are dealt by ranges of the column and
    numbered inside their part, after the rows of the parts before. Equal values are in any order, in one part or several."""
    part, before, tie = free_names(df, "part", "before", "tie")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(F.col(by).asc_nulls_first(), F.col(tie))
    dealt = materialise(dealt.withColumn(part, F.spark_partition_id()), "sorted")
    counts = dealt.groupBy(part).agg(F.count("*").alias(before))  # a row for each part
    starts = counts.select(part, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(F.col(by).asc_nulls_first(), tie))
    return dealt.withColumn(place, inside).join(starts, part).withColumn(place, F.col(place) + F.col(before)).drop(part, before, tie)
