"""Queries whose results no SQL states: measured shapes, layouts, clusters. Tests check what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.operators import cells, clustering, measure, raster, stats
from somatrix.plans.queries import points, rounded
from somatrix.plans.views import DENSE, SPARSE, foreground
from somatrix.tables import table


def measure_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, hull and skeleton features of each component of the raster with three pixels or more."""
    labelled = raster.label_components(foreground(spark, sf_dir, SPARSE), 8)
    boxes = raster.number_cells(raster.component_stats(labelled), least=3)
    cropped = labelled.join(boxes.select("img", "label", "cell"), ["img", "label"]).select("img", "cell", "r", "c")
    found = measure.measure(cropped).withColumn("hull_corners", F.size("hull_corners"))
    return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])


def cell_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact row of each component of the raster with three pixels or more, with kernels and rings that suit its size."""
    found = cells.cell_facts(foreground(spark, sf_dir, DENSE), 3, iterations=1, frame=0, spur=0, sizes=(2, 4, 8, 16), first=2, step=2)
    found = found.withColumn("hull_corners", F.size("hull_corners"))
    return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])


def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.hdbscan(points(spark, sf_dir), 5, 5)


def hdbscan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``hdbscan_labels``, but all points together aren't a cluster, so that parts and noise show."""
    return clustering.hdbscan(points(spark, sf_dir), 5, 5, allow_single_cluster=False)


def hdbscan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How clusters and labels meet."""
    found = clustering.hdbscan(points(spark, sf_dir), 5, 5)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return stats.counts(found.join(labels, "id"), "cluster", "label")


def umap_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.umap_layout(points(spark, sf_dir), 10, 0.1), "umap_1", "umap_2")


QUERIES = {f.__name__: f for f in (measure_cells, cell_facts, hdbscan_labels, hdbscan_nested, hdbscan_report, umap_embed)}
