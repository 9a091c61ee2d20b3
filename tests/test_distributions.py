"""Ranks, quartiles, kernel densities and memberships against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somatrix.operators import neighbors, stats


def rows(spark, data):
    return spark.createDataFrame(data, "feature string, `group` string, value double")


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(3)
    data = [("a", g, float(v)) for g in "xyz" for v in np.round(rng.gamma(2, 3, 400), 1)]
    data += [("a", "x", 5.0)] * 700 + [("b", "x", float(v)) for v in rng.standard_normal(300)]
    return data


@pytest.mark.parametrize("block", [20, 100_000])
def test_mid_ranks_over_many_ranges(spark, drawn, block):
    got = stats.mid_ranks(rows(spark, [*drawn, ("a", "y", None)]), block).toPandas()
    frame = pd.DataFrame(drawn, columns=["feature", "group", "value"])
    frame["rank"] = frame.groupby("feature")["value"].rank()
    expected = frame.groupby(["feature", "group", "value"]).agg(n=("rank", "size"), rank=("rank", "first")).reset_index()
    both = got.merge(expected, on=["feature", "group", "value"], suffixes=("", "_e"))
    assert len(both) == len(got) == len(expected)
    assert (both["n"] == both["n_e"]).all() and np.allclose(both["rank"], both["rank_e"])


@pytest.mark.parametrize("block", [30, 100_000])
def test_quartiles(spark, drawn, block):
    got = {(r["feature"], r["group"]): r for r in stats.quartiles(rows(spark, [*drawn, ("c", "one", 7.0)]), block).collect()}
    frame = pd.DataFrame(drawn, columns=["feature", "group", "value"])
    for key, part in frame.groupby(["feature", "group"]):
        r = got[key]
        assert [r["least"], r["q1"], r["median"], r["q3"], r["most"]] == pytest.approx(np.quantile(part["value"], [0, 0.25, 0.5, 0.75, 1]))
        assert r["n"] == len(part) and r["deviation"] == pytest.approx(part["value"].std())
    one = got[("c", "one")]
    assert (one["q1"], one["median"], one["q3"], one["deviation"]) == (7.0, 7.0, 7.0, None)
    assert stats.quartiles(rows(spark, [])).count() == 0


def test_densities(spark, drawn):
    data = [*drawn, ("c", "one", 7.0), ("c", "equal", 2.0), ("c", "equal", 2.0)]
    got = stats.densities(rows(spark, data), places=512, cut=4.0).toPandas()
    assert set(zip(got["feature"], got["group"])) == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")}
    frame = pd.DataFrame(drawn, columns=["feature", "group", "value"])
    for key, part in got.groupby(["feature", "group"]):
        part, values = part.sort_values("place"), frame[(frame["feature"] == key[0]) & (frame["group"] == key[1])]["value"].to_numpy()
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1, abs=1e-3)
        iqr = np.subtract(*np.quantile(values, [0.75, 0.25])) / 1.34
        spread = min(values.std(ddof=1), iqr) or values.std(ddof=1)
        h = 0.9 * spread * len(values) ** -0.2
        exact = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
        assert np.abs(part["density"] - exact).max() < 0.01 * exact.max()
    trimmed = stats.densities(rows(spark, drawn), places=64).filter("feature = 'b'").agg(F.min("x"), F.max("x"), F.count("*")).first()
    values = frame[frame["feature"] == "b"]["value"]
    assert tuple(trimmed) == pytest.approx((values.min(), values.max(), 64))
    assert stats.densities(rows(spark, [])).count() == 0


def test_significant(spark):
    pairs = spark.createDataFrame([("a", 0.01), ("b", 0.05), ("c", None)], "pair string, p double")
    assert [r["pair"] for r in stats.significant(pairs).collect()] == ["a"]


def test_memberships(spark):
    rng = np.random.default_rng(4)
    near = neighbors.knn(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(rng.random((60, 3)))], "id long, vec array<double>"), 6)
    extra = spark.createDataFrame([(900, 1, 0.0, 1), (900, 2, 0.0, 2), (901, 1, 0.0, 1), (901, 3, 2.0, 2)], near.schema)
    w = neighbors.memberships(near.unionByName(extra), 6).toPandas()
    assert len(w) == 364 and not w.duplicated(["src", "dst"]).any()
    sums = w[w["src"] < 900].groupby("src")["w"].sum()
    assert np.allclose(sums, np.log2(6), atol=1e-4)
    closest = near.filter("rank = 1").toPandas().merge(w, on=["src", "dst"])
    assert np.allclose(closest["w"], 1.0)
    assert (w[w["src"] == 900]["w"] == 1).all()


def test_local_dimension(spark):
    """A plane and a line in ten dimensions, and copies."""
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.standard_normal((10, 2)))[0]
    plane, line = rng.random((120, 2)) @ basis.T, 50 + rng.random((40, 1)) * basis[:, 0]
    x = np.vstack([plane, line, np.full((12, 10), 99.0)])
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    near = neighbors.knn(points, 10)
    found = {r["id"]: r["dimension"] for r in neighbors.local_dimension(points, near, 0.999, lists=20).collect()}
    assert len(found) == 172
    assert {found[i] for i in range(120)} == {2} and {found[i] for i in range(120, 160)} == {1} and {found[i] for i in range(160, 172)} == {0}
    assert neighbors.local_dimension(points, near.filter("false")).count() == 0
