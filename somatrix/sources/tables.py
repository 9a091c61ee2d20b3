"""Feature and fact tables as files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.functions.text import DIMENSIONS, box_from_text

_DOUBLES = ("perimeter", "circularity", "compactness", "orientation", "feret_diameter", "eccentricity", "aspect_ratio")
#: Columns of the per-image feature files, in their order.
SCHEMAS = {
    "Cell_Positions": "Cell INT, cell_positions STRING",
    "Cell_features": "Cell INT, Cell_area INT, " + ", ".join(f"Cell_{x} DOUBLE" for x in _DOUBLES),
    "Soma_features": "Cell INT, Soma_area INT, " + ", ".join(f"Soma_{x} DOUBLE" for x in _DOUBLES),
    "Skeleton_features": "Cell INT, End_Points INT, Junctions INT, Branches INT, Initial_Points INT, Total_Branches_Length INT, ratio_branches DOUBLE",
    "Sholl_Analysis": "Cell INT, Sholl_max_distance DOUBLE, Sholl_crossing_processes INT, Sholl_circles INT",
    "Convex_Hull_Analysis": "Cell INT, Convex_Hull_area INT, Convex_Hull_perimeter DOUBLE, Convex_Hull_compactness DOUBLE, Fractal_dimension DOUBLE, Convex_Hull_eccentricity DOUBLE, Convex_Hull_feret_diameter DOUBLE, Convex_Hull_orientation DOUBLE",
}


def read_features(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """All files of one kind in one scan, with ``path``. A row of another form fails the read."""
    read = spark.read.schema(SCHEMAS[kind]).option("header", True).option("mode", "FAILFAST").csv(paths)
    found = read.withColumn("path", F.input_file_name())
    return found.withColumn("box", box_from_text(F.col("cell_positions"))) if kind == "Cell_Positions" else found


def selected_features(features: DataFrame, column: str = "feature", most: int = 1000) -> list[str]:
    """The names in a list of selected features, which parameterise later steps on the driver."""
    rows = features.select(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features")
    return [r[0] for r in rows]


def write_facts(facts: DataFrame, path: str, by: tuple[str, ...] = DIMENSIONS[::-1]) -> None:
    """One partition folder for each combination of ``by``, in one job."""
    facts.write.mode("overwrite").partitionBy(*[c for c in by if c in facts.columns]).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header; as many as partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)
