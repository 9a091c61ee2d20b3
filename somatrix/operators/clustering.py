"""Density clustering with a hierarchy (HDBSCAN), and a two-dimensional layout of the neighbour graph (UMAP)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatrix.operators import hierarchy, layout
from somatrix.operators.neighbors import fuzzy_union, knn, memberships, spanning_tree
from somatrix.tables import materialise


def hdbscan(points: DataFrame, min_cluster_size: int, min_samples: int, k: int | None = None, allow_single_cluster: bool = True, near: DataFrame | None = None) -> DataFrame:
    """(id, cluster) of ``points`` (id, vec); noise is -1, clusters count from 0 in order of their least ids.

    The spanning tree is that of the graph of the ``k`` nearest neighbours (at least twice ``min_samples``), whose parts are
    then joined by their lightest mutual reachability, found exactly among all points. Merges are contracted in rounds
    (``hierarchy``). ``near`` gives the neighbours where they are known already. ``min_samples`` above the number of points
    counts as that number."""
    n = points.count()
    samples = max(1, min(min_samples, n))
    if near is None:
        near = materialise(knn(points, min(max(n - 1, 1), max(k or 15, 2 * samples))), "neighbours")
    tree = materialise(spanning_tree(points, near, samples), "tree")
    return hierarchy.labels(points.select("id"), tree, min_cluster_size, allow_single_cluster)


def hdbscan_grid(points: DataFrame, sizes: tuple[int, ...], samples: tuple[int, ...]) -> DataFrame:
    """(id, cluster, min_cluster_size, min_samples): a clustering for each combination, over one table of neighbours."""
    near = materialise(knn(points, max(2 * max(samples), 15)), "neighbours")
    found = None
    for size, sample in grid(sizes, samples):
        one = hdbscan(points, size, sample, near=near).withColumns({"min_cluster_size": F.lit(size), "min_samples": F.lit(sample)})
        found = one if found is None else found.unionByName(one)
    return found


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^2b) is closest to 1 up to ``min_dist`` and to an exponential beyond."""
    x = np.linspace(0, 3 * spread, 300)
    goal = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    best = (np.inf, 1.0, 1.0)
    a_low, a_high, b_low, b_high = 0.01, 10.0, 0.2, 2.5
    for _ in range(6):
        for a in np.geomspace(a_low, a_high, 24):
            for b in np.linspace(b_low, b_high, 24):
                best = min(best, (float(((1 / (1 + a * x ** (2 * b)) - goal) ** 2).sum()), float(a), float(b)))
        _, a, b = best
        step_a, step_b = (a_high / a_low) ** (1 / 12), (b_high - b_low) / 12
        a_low, a_high, b_low, b_high = a / step_a, a * step_a, max(0.05, b - step_b), b + step_b
    return best[1], best[2]


def umap_layout(points: DataFrame, n_neighbors: int, min_dist: float, seed: int = 24, epochs: int | None = None, negatives: int = 5, near: DataFrame | None = None) -> DataFrame:
    """(id, umap_1, umap_2): a layout of the fuzzy graph of ``points`` (id, vec).

    The graph is relational. Each epoch moves all points at once (``layout``): attraction along all edges, repulsion
    from ``negatives`` points that a hash of (id, epoch) draws. Unlike a sequential descent this spreads over tasks, and
    the same seed gives the same layout; coordinates differ from those of other implementations. Without ``epochs`` there
    are as many as umap-learn takes: 500, or 200 for more than 10,000 points. ``near`` gives the neighbours where
    ``n_neighbors`` or more are known already."""
    a, b = curve(min_dist)
    near = materialise(knn(points, n_neighbors), "neighbours") if near is None else near.filter(F.col("rank") <= n_neighbors)
    graph = fuzzy_union(memberships(near, n_neighbors))
    ids = points.select("id")
    n = ids.count()
    if epochs is None:
        epochs = 500 if n <= 10_000 else 200

    def uniform(salt: int):
        return (F.pmod(F.xxhash64("id", F.lit(seed * 1000 + salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 20

    number = F.monotonically_increasing_id()
    numbered = materialise(ids.select("id", uniform(1).alias("x"), uniform(2).alias("y"), F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "layout")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("start"))  # one row a partition
    slots = materialise(numbered.join(starts, "part").select((F.col("start") + F.col("place")).alias("slot"), "id", F.xxhash64("id").alias("key"), "x", "y"), "slots")
    a_slot, b_slot = (slots.select(F.col("id").alias(c), F.col("slot").alias(f"{c}_slot")) for c in ("a", "b"))
    met = materialise(graph.join(a_slot, "a").join(b_slot, "b").select("a_slot", "b_slot", "w"), "graph")
    both = met.toDF("src", "dst", "w").unionByName(met.toDF("dst", "src", "w"))
    moved = layout.descend(slots.drop("id"), both, n, a, b, seed, epochs, negatives)
    return slots.select("id", "slot").join(moved, "slot").select("id", F.col("x").alias("umap_1"), F.col("y").alias("umap_2"))


def umap_grid(points: DataFrame, neighbours: tuple[int, ...] = (10, 15, 20, 30, 50), distances: tuple[float, ...] = (0.01, 0.05, 0.1), **options) -> DataFrame:
    """(id, umap_1, umap_2, n_neighbors, min_dist): a layout for each combination, over one table of neighbours."""
    near = materialise(knn(points, max(neighbours)), "neighbours")
    found = None
    for k, distance in grid(neighbours, distances):
        one = umap_layout(points, k, distance, near=near, **options).withColumns({"n_neighbors": F.lit(k), "min_dist": F.lit(distance)})
        found = one if found is None else found.unionByName(one)
    return found


def umap_hdbscan_grid(points: DataFrame, neighbours: tuple[int, ...], distances: tuple[float, ...], sizes: tuple[int, ...], samples: tuple[int, ...], **options) -> DataFrame:
    """(id, cluster, n_neighbors, min_dist, min_cluster_size, min_samples): each layout of a grid, made once, clustered with
    each combination of the other two."""
    laid = materialise(umap_grid(points, neighbours, distances, **options), "layouts")
    found = None
    for k, distance in grid(neighbours, distances):
        flat = laid.filter((F.col("n_neighbors") == k) & (F.col("min_dist") == distance)).select("id", F.array("umap_1", "umap_2").alias("vec"))
        one = hdbscan_grid(flat, sizes, samples).withColumns({"n_neighbors": F.lit(k), "min_dist": F.lit(distance)})
        found = one if found is None else found.unionByName(one)
    return found


def grid(*lists: tuple) -> list[tuple]:
    """All combinations of parameter values, the last one changing fastest."""
    out: list[tuple] = [()]
    for values in lists:
        out = [(*x, v) for x in out for v in values]
    return out
