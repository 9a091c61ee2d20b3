"""Connected components of an edge table, by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatrix.tables import materialise, release

#: Up to so many links one task joins them: rounds of contractions would be some dozens of stages for a few kilobytes. The
#: bound is fixed, so what that task holds doesn't grow with the table.
FEW = 100_000


def _with_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Rows (u, v, m): v is a neighbour of u (both ways, or only the smaller ones) and m the least of u and these."""
    if both_ways:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v) of a few."""
    top: dict = {}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            top.setdefault(u, u)
            top.setdefault(v, v)
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
        kind = batch.schema.field("u").type
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(list(top), kind), pa.array([find(x) for x in top], kind)], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of equal type, the ends of each link. Gives (node, root): every node that has a link
    to another, and the least node that it reaches. Self-links, repeated links and links both ways do no harm; no
    links give no rows. Each round is two groupings of the links, which shrink to one star a component; nothing is
    gathered by node or component. Up to ``FEW`` links of numbers or strings are joined in one task instead.
    """
    a, b = links.columns
    given = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    given = materialise(given, "links")
    kind = dict(given.dtypes)["u"]
    if kind in ("bigint", "int", "string") and given.limit(FEW + 1).count() <= FEW:
        return given.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}")
    edges = materialise(given.distinct(), "links")
    release(given)
    state = None
    while True:
        large = _with_least(edges, both_ways=True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        small = _with_least(large, both_ways=False)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        earlier, edges = edges, materialise(small.filter("u != v").distinct(), "links")
        release(earlier)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
