"""Approximate neighbours against the exact table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from somatrix.operators import descent, neighbors


def frame(spark, x, first=0):
    rows = [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def recall(spark, points, k):
    exact = neighbors.knn(points, k).groupBy("src").agg(F.max("d").alias("reach"))
    found = descent.approximate_knn(points, k).toPandas()
    whole = found.merge(exact.toPandas(), on="src")
    assert not found.duplicated(["src", "dst"]).any() and (found["src"] != found["dst"]).all()
    return (whole["d"] <= whole["reach"] + 1e-9).sum() / (len(exact.toPandas()) * k), found


@pytest.mark.parametrize("shape", ["uniform", "blobs"])
def test_recall(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.random((2500, 8))
    if shape == "blobs":
        x = rng.standard_normal((2500, 24)) + 6 * rng.standard_normal((12, 24))[rng.integers(0, 12, 2500)]
    share, found = recall(spark, frame(spark, x), 10)
    assert share >= 0.95
    assert (found.groupby("src").size() == 10).all()


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.random((1800, 6))
    x[rng.permutation(1800)[:600]] = x[0]
    share, found = recall(spark, frame(spark, x), 8)
    assert share >= 0.95
    copies = np.flatnonzero((x == x[0]).all(axis=1))
    assert (found[found["src"].isin(copies)]["d"] == 0).mean() >= 0.95


def test_few_points_are_exact(spark):
    x = np.random.default_rng(7).random((40, 3))
    points = frame(spark, x, first=100)
    near = descent.approximate_knn(points, 5).orderBy("src", "rank").select("src", "dst").collect()
    assert near == neighbors.knn(points, 5).orderBy("src", "rank").select("src", "dst").collect()


def test_none_one_and_fewer_than_k(spark):
    assert descent.approximate_knn(frame(spark, []), 3).count() == 0
    assert descent.approximate_knn(frame(spark, [[1.0, 2.0]]), 3).count() == 0
    assert descent.approximate_knn(frame(spark, [[1.0], [2.0], [4.0]]), 9).count() == 6


@pytest.mark.parametrize("shape", ["spread", "offset", "copies", "grid", "outlier", "tiny", "huge"])
def test_exact_neighbours_by_tiles(monkeypatch, shape):
    """Tiles of products in single precision rule out no neighbour: those of all pairs measured one by one, ties by id."""
    monkeypatch.setattr(neighbors, "ROWS", 32)
    monkeypatch.setattr(neighbors, "FIRST", 8)
    monkeypatch.setattr(neighbors, "COLUMNS", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6))
    if shape == "grid":
        x = rng.integers(0, 3, (300, 6)).astype(float)
    elif shape == "copies":
        x[40:200] = x[40]
    elif shape == "outlier":
        x[7] *= 1e7
    x = x * {"tiny": 1e-30, "huge": 1e40}.get(shape, 1) + (1e6 if shape == "offset" else 0)
    ids = np.arange(300) * 3
    i, j, d = neighbors._nearest(x[:250], ids[:250], x, ids, 5)
    for at in range(250):
        every = np.sqrt(((x[at] - x) ** 2).sum(axis=1))
        want = [b for b in np.lexsort((ids, every)) if b != at][:5]
        assert j[i == at].tolist() == want and d[i == at].tolist() == every[want].tolist()


def test_rows_travel_as_often_however_many(spark):
    """Rows that meet in blocks grow with the points, up to the bound of a block's memory."""
    def travelled(n):
        points = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("vec"))
        met = neighbors._met(points, points, None).applyInArrow(lambda t: pa.table({"n": [t.num_rows]}), "n long")
        return met.agg(F.sum("n")).first()[0] / n

    assert travelled(12_000) == travelled(48_000) <= 24
    assert neighbors._blocks(600_000, 64, None, neighbors.BLOCKS) == neighbors.BLOCKS
    assert neighbors._blocks(10_000_000, 64, None, neighbors.BLOCKS) > neighbors.BLOCKS


@pytest.mark.parametrize("name", ["mutual_reach", "neighborhood_jaccard"])
def test_neighbours_are_searched_once(spark, sf_dir, name):
    """Queries that read the neighbours more than once read a stored table."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in plan


def test_lightest_edges_between_parts(spark):
    """Each part's least mutual reachability to another, but that of the part that doesn't search."""
    rng = np.random.default_rng(9)
    x, core, part = rng.integers(0, 9, (240, 3)).astype(float), rng.integers(0, 3, 240).astype(float), rng.integers(0, 5, 240)
    rows = [(i, v.tolist(), float(c), int(p)) for i, (v, c, p) in enumerate(zip(x, core, part, strict=True))]
    found = neighbors.lightest_between(spark.createDataFrame(rows, "id long, vec array<double>, core double, part long"), 3, block=50)
    w = np.maximum(np.maximum(np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), core), core[:, None])
    want = set()
    for p in (0, 1, 2, 4):
        best, u, v = min((w[i, j], min(i, j), max(i, j)) for i in np.flatnonzero(part == p) for j in np.flatnonzero(part != p))
        want.add((u, v, best, p, part[v] if part[u] == p else part[u]))
    assert {tuple(r) for r in found.collect()} == want


def test_lists_are_compared_in_arrow(spark):
    """Lists and vectors don't become Python's objects, and the pairs are those that a loop finds."""
    x = np.random.default_rng(7).normal(size=(40, 3)).round(3)
    near = neighbors.knn(frame(spark, x), 4).withColumn("fresh", (F.col("src") + F.col("dst")) % 3 == 0).localCheckpoint()
    found = descent._compared(frame(spark, x), near, 4, 40)
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()

    rows = [tuple(r) for r in near.select("src", "dst", "d", "fresh").collect()]
    lists, reach = {i: {} for i in range(40)}, dict.fromkeys(range(40), 0.0)
    for i in range(40):
        back = sorted((d, src, fresh) for src, dst, d, fresh in rows if dst == i)[:4]
        for other, fresh in [(dst, f) for src, dst, _, f in rows if src == i] + [(src, f) for _, src, f in back]:
            lists[i][other] = lists[i].get(other, False) or fresh
        reach[i] = max(d for src, _, d, _ in rows if src == i)
    wanted = set()
    for held in lists.values():
        for a in held:
            for b in held:
                if a != b and (held[a] or held[b]) and np.sqrt(((x[a] - x[b]) ** 2).sum()) < reach[a]:
                    wanted.add((a, b))
    assert wanted and {(r["src"], r["dst"]) for r in found.collect()} == wanted
