"""Clusters of most excess of mass from a minimum spanning tree, by contraction in rounds.

Edges are ordered by (w, src, dst), so all are different. In each round every part that has fewer than ``least`` points when
its lightest edge comes folds into the part at the other end of that edge; its points *join* at that edge. The number of such
parts at least halves, so the rounds are as many as the logarithm of the points. What can't fold any further has ``least``
points on both sides of every edge left: these edges are the splits of the hierarchy, and only they, one row a cluster, are
put together in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.operators.graph import components
from somatrix.tables import materialise


def fold(ids: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Points (id, vertex, joined) and the edges left (a, b, e) between vertices, from ``ids`` (id) and ``tree`` (src, dst, w).

    ``joined`` and ``e`` are edges (w, u, v); a point that was there from the start has w = -1. A vertex at time ``t`` holds
    its points with ``joined < t``."""
    start = F.struct(F.lit(-1.0).alias("w"), F.col("id").alias("u"), F.col("id").alias("v"))
    active = ids.select("id", F.col("id").alias("vertex"), start.alias("joined"))
    edges = materialise(tree.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", F.col("src").alias("u"), F.col("dst").alias("v")).alias("e")), "tree")
    settled = None
    while True:
        ends = edges.select(F.col("a").alias("vertex"), F.col("b").alias("other"), "e").unionByName(edges.select(F.col("b").alias("vertex"), F.col("a").alias("other"), "e"))
        first = ends.groupBy("vertex").agg(F.min("e").alias("e"), F.min_by("other", "e").alias("other"))
        counted = active.join(first, "vertex").groupBy("vertex", "e", "other").agg(F.count_if(F.col("joined") < F.col("e")).alias("n"))
        small = materialise(counted.filter(F.col("n") < least).drop("n"), "small")
        if small.isEmpty():
            return active if settled is None else settled.unionByName(active), edges
        # of the vertices that fold together at most one isn't small: it keeps its name, and its points never change again
        met = components(small.select("vertex", "other")).join(small.select(F.col("vertex").alias("node"), F.lit(True).alias("small")), "node", "left")
        large = met.groupBy("root").agg(F.max(F.when(F.col("small").isNull(), F.col("node"))).alias("large"))
        names = materialise(met.join(large, "root").select("node", F.coalesce("large", "root").alias("name"), F.col("large").isNotNull().alias("held")), "names")
        moved = active.join(small, "vertex", "left").join(names.withColumnRenamed("node", "vertex"), "vertex", "left")
        joined = F.greatest("joined", F.coalesce("e", "joined")).alias("joined")
        moved = moved.select("id", F.coalesce("name", "vertex").alias("vertex"), joined, (F.col("e").isNull() | F.col("held")).alias("done"))
        moved = materialise(moved, "points")
        done, active = moved.filter("done").drop("done"), moved.filter("not done").drop("done")
        settled = done if settled is None else settled.unionByName(done)
        for c in ("a", "b"):
            edges = edges.join(names.filter("node != name").select(F.col("node").alias(c), "name"), c, "left").withColumn(c, F.coalesce("name", c)).drop("name")
        edges = materialise(edges.filter("a != b").select("a", "b", "e"), "tree")


def fallen(points: DataFrame, least: int) -> DataFrame:
    """``points`` of ``fold`` with ``fell`` in place of ``joined``: the edge at which a point leaves its cluster, seen from
    the root. That is where it joined, or where its vertex came to ``least`` points if that was later; null where the vertex
    never did."""
    place = F.row_number().over(Window.partitionBy("vertex").orderBy("joined", "id"))
    born = points.withColumn("place", place).filter(F.col("place") == least).select("vertex", F.col("joined").alias("born"))
    return points.join(born, "vertex", "left").select("id", "vertex", F.when(F.col("born").isNotNull(), F.greatest("joined", "born")).alias("fell"))


def split_tree(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, node, up, vertex, w, u, v): the clusters of ``leaves`` (vertex) merged over ``edges`` (a, b, e) in order.

    Each node has a row of level -1, with its vertex if it is a leaf and the edge that made it if not; a row of level k tells
    the node 2^k above, if there is one, and the edge that made that. One row a cluster goes through one task."""
    kind = dict(leaves.dtypes)["vertex"]
    rows = leaves.select("vertex", F.lit(None).cast(kind).alias("b"), F.lit(-1.0).alias("w"), F.lit(None).cast(kind).alias("u"), F.lit(None).cast(kind).alias("v"))
    rows = rows.unionByName(edges.select(F.col("a").alias("vertex"), "b", "e.w", "e.u", "e.v"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame.loc[frame["w"] < 0, "vertex"].sort_values().tolist()
        splits = frame[frame["w"] >= 0].sort_values(["w", "u", "v"])
        n, place = len(names), {x: i for i, x in enumerate(names)}
        top, up = list(range(n + len(splits))), np.full(n + len(splits), -1)

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for new, (a, b) in enumerate(zip(splits["vertex"], splits["b"], strict=True), n):
            for x in (find(place[a]), find(place[b])):
                top[x] = up[x] = new
        made = {c: [None] * n + splits[c].tolist() for c in ("w", "u", "v")}
        out = [(-1, i, -1, names[i] if i < n else None, made["w"][i], made["u"][i], made["v"][i]) for i in range(len(up))]
        level, above = 0, up
        while (above >= 0).any():
            out += [(level, int(i), int(above[i]), None, *(made[c][above[i]] for c in ("w", "u", "v"))) for i in np.flatnonzero(above >= 0)]
            above = np.where(above >= 0, above[above], -1)
            level += 1
        return pd.DataFrame(out, columns=["level", "node", "up", "vertex", "w", "u", "v"])

    return rows.groupBy(F.lit(1).alias("all")).applyInPandas(merge, f"level int, node int, up int, vertex {kind}, w double, u {kind}, v {kind}")


def most_excess(rows: pd.DataFrame, allow_single: bool) -> pd.DataFrame:
    """(vertex, cluster, w, u, v): the leaves below a chosen cluster, its number, and the edge up to which points of the leaf
    belong to it (null: all). ``rows`` are those of ``split_tree`` of levels -1 and 0, with ``n``, ``total`` and ``first``: how
    many points fell out of the node, the sum of their inverse distances, and the least id."""
    own = rows[rows["level"] == -1].sort_values("node")
    up = np.full(len(own), -1)
    above = rows[rows["level"] == 0]
    up[above["node"].to_numpy(int)] = above["up"].to_numpy(int)
    death = above.set_index("node")
    at = [inverse(w) if w == w and w is not None else 0.0 for w in own["w"]]
    n, total, first = own["n"].fillna(0).to_numpy(int), own["total"].fillna(0).to_numpy(float), own["first"].tolist()
    size, stability, best = n.copy(), np.zeros(len(own)), np.zeros(len(own))
    inside, chosen = np.zeros(len(own)), np.zeros(len(own), bool)
    below: list[list[int]] = [[] for _ in up]
    for i in range(len(up)):  # children come before their parents
        birth = at[up[i]] if up[i] >= 0 else 0.0
        parts = int(size[i] - n[i])
        stability[i] = max(0.0, total[i] - n[i] * birth) + parts * max(0.0, at[i] - birth)
        best[i] = stability[i]
        if (up[i] >= 0 or allow_single) and (stability[i] >= inside[i] or not below[i]):
            chosen[i] = True
        else:
            best[i] = inside[i]
        if up[i] >= 0:
            size[up[i]] += size[i]
            inside[up[i]] += best[i]
            below[up[i]].append(i)
    head = np.full(len(up), -1)
    for i in reversed(range(len(up))):  # the highest chosen one
        head[i] = head[up[i]] if up[i] >= 0 and head[up[i]] >= 0 else i if chosen[i] else -1
    least: dict[int, object] = {}
    for i, h in enumerate(head):
        if h >= 0 and n[i] and (h not in least or first[i] < least[h]):
            least[h] = first[i]
    number = {h: k for k, h in enumerate(sorted(least, key=least.get))}
    out = []
    for i, vertex in zip(own["node"], own["vertex"], strict=True):
        if not below[i] and head[i] in number:
            edge = death.loc[head[i], ["w", "u", "v"]].tolist() if head[i] in death.index else [None] * 3
            out.append((vertex, number[head[i]], *edge))
    return pd.DataFrame(out, columns=["vertex", "cluster", "w", "u", "v"])


def inverse(w: float) -> float:
    """One by a distance; of no distance, a large number."""
    return 1 / w if w > 0 else 1e12


def labels(ids: DataFrame, tree: DataFrame, least: int, allow_single: bool = True) -> DataFrame:
    """(id, cluster) for every row of ``ids`` (id, without nulls or repeats), by the spanning ``tree`` (src, dst, w) over them.

    -1 is noise; clusters count from 0 in order of their least ids. Equal weights are ordered by their ends. ``least`` is 2
    or more. No points give no rows; fewer than ``least`` are noise. A tree that leaves points apart isn't one: join its parts first."""
    if least < 2:
        raise ValueError("a cluster has two points or more")
    kind = dict(ids.dtypes)["id"]
    members, edges = fold(ids, tree, least)
    points = materialise(fallen(members, least), "fallen")
    nodes = materialise(split_tree(points.filter("fell is not null").select("vertex").distinct(), edges), "clusters")
    made = F.when(F.col("up") >= 0, F.struct("w", "u", "v"))
    jump = nodes.filter("level >= 0").select("level", "node", "up", made.alias("at"))
    leaf = nodes.filter("level = -1 and vertex is not null").select("vertex", "node")
    first = jump.filter("level = 0").select("node", F.col("at").alias("death"))
    placed = points.filter("fell is not null").join(leaf.join(first, "node", "left"), "vertex")
    late = F.coalesce(F.col("fell") > F.col("death"), F.lit(False))
    early, above = placed.filter(~late).select("id", "node", "fell"), placed.filter(late).select("id", "node", "fell")
    most = jump.agg(F.max("level")).first()[0]
    for level in reversed(range(0 if most is None else most + 1)):
        step = jump.filter(F.col("level") == level).drop("level")
        above = above.join(step, "node", "left").select("id", F.when(F.col("at") < F.col("fell"), F.col("up")).otherwise(F.col("node")).alias("node"), "fell")
    weight: Column = F.when(F.col("fell.w") > 0, 1 / F.col("fell.w")).otherwise(1e12)
    sums = early.unionByName(above).groupBy("node").agg(F.count("*").alias("n"), F.sum(weight).alias("total"), F.min("id").alias("first"))
    rows = nodes.filter("level <= 0").join(sums, "node", "left")
    shape = f"vertex {kind}, cluster int, w double, u {kind}, v {kind}"
    chosen = rows.groupBy(F.lit(1).alias("all")).applyInPandas(lambda frame: most_excess(frame, allow_single), shape)
    chosen = materialise(chosen.select("vertex", "cluster", F.when(F.col("w").isNotNull(), F.struct("w", "u", "v")).alias("until")), "chosen")
    inside = F.col("cluster").isNotNull() & F.col("fell").isNotNull() & F.coalesce(F.col("fell") < F.col("until"), F.lit(True))
    return points.join(chosen, "vertex", "left").select("id", F.when(inside, F.col("cluster")).otherwise(-1).alias("cluster"))
