"""Layouts against a version that holds all points at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatrix.operators import clustering, layout
from somatrix.plans import clustering_queries, queries


def test_umap_settles(spark, sf_dir):
    """The query takes as many epochs as its points move in: neighbours end near each other, which six epochs leave as far
    apart as any two points."""
    found = clustering_queries.umap_embed(spark, sf_dir).toPandas().set_index("id").sort_index()
    near = queries.knn(spark, sf_dir).toPandas()
    assert len(found) == near["src"].nunique()
    apart = lambda src, dst: np.sqrt(((found.loc[src].to_numpy() - found.loc[dst].to_numpy()) ** 2).sum(axis=1)).mean()
    rng = np.random.default_rng(1)
    assert apart(near["src"], near["dst"]) < 0.75 * apart(rng.choice(found.index, 20000), rng.choice(found.index, 20000))


@pytest.mark.parametrize(("points", "block"), [(97, 10), (97, 1000), (3, 1)])
def test_blocks_equal_all_at_once(spark, monkeypatch, points, block):
    """Several blocks and one, a point with most edges, one without any, and two at one place, over more than one plan."""
    monkeypatch.setattr(layout, "LEAST", block)
    monkeypatch.setattr(layout, "EPOCHS", 2)
    rng, a, b, seed, epochs, negatives = np.random.default_rng(3), 1.5, 0.9, 24, 5, 4
    start = rng.uniform(-10, 10, (points, 2))
    start[1] = start[0]
    pairs = {(0, i) for i in range(1, points - 1)} | {(i, i + 1) for i in range(points - 2)}
    edges = [(s, t, 1 / (1 + i + j)) for i, j in sorted(pairs) for s, t in ((i, j), (j, i))]
    at = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(start)], "slot long, x double, y double").withColumn("key", F.xxhash64("slot"))
    found = layout.descend(at, spark.createDataFrame(edges, "src long, dst long, w double"), points, a, b, seed, epochs, negatives)
    draws = F.array(*[F.pmod(F.xxhash64("id", F.lit(seed + e), F.lit(j)), F.lit(points)) for e in range(epochs) for j in range(negatives)])
    drawn = np.array([r[0] for r in spark.range(points).orderBy("id").select(draws).collect()]).reshape(points, epochs, negatives)
    place = start.copy()
    for epoch in range(epochs):
        moves = np.zeros_like(place)
        for i, j, w in edges:
            d = place[i] - place[j]
            dd = d @ d
            moves[i] += w * -2 * a * b * max(dd, 1e-9) ** (b - 1) / (1 + a * dd**b) * d
        for i in range(points):
            for j in drawn[i, epoch]:
                d = place[i] - place[j]
                dd = d @ d
                moves[i] += np.clip(2 * b / ((0.001 + dd) * (1 + a * dd**b)) * d, -4, 4)
        place += (1 - epoch / epochs) * np.clip(moves, -4, 4)
    rows = found.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(points))
    assert np.array([(r["x"], r["y"]) for r in rows]) == pytest.approx(place, abs=1e-6)


def test_layout_of_few_points(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "id string, vec array<double>")
        return {r["id"]: (r["umap_1"], r["umap_2"]) for r in clustering.umap_layout(df, 3, 0.1, epochs=2).collect()}

    assert run([]) == {}
    assert len(run([("a", [0.0])])) == 1
    copies = run([(str(i), [1.0, 2.0]) for i in range(5)])
    assert len(copies) == 5 and np.isfinite(list(copies.values())).all()
