"""Every query with SQL against DuckDB over the smallest tables; shapes and graphs against known answers."""

import glob
import math
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somatrix.functions import text
from somatrix.functions.shape import ratio
from somatrix.functions.survival import upper_gamma
from somatrix.operators import clustering, facts, measure, neighbors, raster, selection
from somatrix.operators.graph import components
from somatrix.plans import queries as plans


def table(spark, pixels, img=0):
    return spark.createDataFrame([(img, int(r), int(c)) for r, c in pixels], "img int, r long, c long")


def values(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "none"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {Path(f).stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, sf_dir, duck, name):
    ours, theirs = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


def test_components_across_tiles(spark):
    spiral = [(0, c) for c in range(20)] + [(r, 19) for r in range(20)] + [(19, c) for c in range(20)] + [(r, 0) for r in range(4, 20)] + [(4, c) for c in range(12)]
    df = table(spark, {*spiral, (10, 10), (11, 11)})
    assert raster.label_components(df, 8, tile=5).select("label").distinct().count() == 2
    assert raster.label_components(df, 4, tile=5).select("label").distinct().count() == 3
    assert raster.label_components(df.filter("false"), 8).count() == 0


def test_components_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def disc(r, size=60):
    y, x = np.indices((size, size)) - size // 2
    return x * x + y * y <= r * r


def test_shapes():
    square = np.zeros((60, 60), bool)
    square[10:50, 10:50] = True
    s = measure.shape(square)
    assert s["area"] == 1600 and s["perimeter"] == 4 * 39 and s["aspect_ratio"] == 1 and s["feret_diameter"] == 39
    assert measure.filled(measure.convex_hull(measure.outline(square))).sum() == 1600
    bar = np.zeros((60, 60), bool)
    bar[20:25, 5:46] = True
    assert measure.shape(bar)["aspect_ratio"] == 41 / 5
    assert measure.shape(np.zeros((4, 4), bool))["area"] == 0 and measure.shape(np.ones((1, 1), bool))["perimeter"] == 0
    assert measure.axis_ratio(measure.outline(disc(25))) == pytest.approx(1, abs=0.02)
    y, x = np.indices((80, 160)) - np.array([40, 80])[:, None, None]
    assert measure.axis_ratio(measure.outline((x / 60) ** 2 + (y / 30) ** 2 <= 1)) == pytest.approx(0.5, abs=0.02)
    assert measure.centroid(measure.outline(square)) == (29, 29)
    assert len(measure.simplify(measure.outline(disc(25)), 200)) == 2


def test_thinning():
    bar = np.zeros((21, 61), bool)
    bar[8:13, 5:56] = True
    thinned = measure.thin(bar)
    assert 40 <= thinned.sum() <= 51 and (thinned.sum(axis=0) <= 1).all()


def test_measure(spark):
    cells = [(0, 1, r, c) for r in range(3) for c in range(4)] + [(0, 2, 9, 9)]
    found = {r["cell"]: r for r in measure.measure(spark.createDataFrame(cells, "img int, cell int, r long, c long")).collect()}
    assert found[1]["area"] == 12 and found[1]["hull_area"] == 12 and found[1]["solidity"] == 1 and found[2]["flag"] == "few points"


def test_outlines():
    """A frame around a dot has one outline; a second object has its own, and the larger one gives the shape."""
    mask = np.zeros((40, 60), bool)
    mask[5:26, 5:26] = True
    mask[8:23, 8:23] = False
    mask[14:17, 14:17] = True
    mask[30:33, 40:51] = True
    assert sorted(measure.length(x) for x in measure.outlines(mask)) == [2 * (10 + 2), 4 * 20]
    found = measure.shape(mask)
    assert found["perimeter"] == 104 and found["aspect_ratio"] == 1 and found["area"] == mask.sum()


def test_cell_facts(spark):
    """A disc with four straight arms, a bar without a soma, and a dot that is no cell."""
    from somatrix.operators import cells

    star = {(r + 70, c + 80) for r in range(-60, 61) for c in range(-60, 61) if r * r + c * c <= 144 or min(abs(r), abs(c)) <= 1}
    bar = {(r, c) for r in range(150, 155) for c in range(10, 90)}
    pixels = [("a", *p) for p in star | bar | {(190, 5)}] + [("b", *p) for p in star]
    out = {(r["img"], r["Cell"]): r.asDict() for r in cells.cell_facts(spark.createDataFrame(pixels, "img string, r long, c long"), least=100).collect()}
    assert set(out) == {("a", 1), ("a", 2), ("b", 1)}
    a, b, thin = out["a", 1], out["b", 1], out["a", 2]
    assert a.pop("Fractal_dimension") == pytest.approx(b.pop("Fractal_dimension")) and -2 < thin.pop("Fractal_dimension") < 0
    assert {k: v for k, v in a.items() if k != "img"} == {k: v for k, v in b.items() if k != "img"}
    assert a["cell_positions"] == "(20, 10, 141, 131)" and a["Cell_area"] == len(star) and a["Cell_aspect_ratio"] == 1
    assert (a["End_Points"], a["Initial_Points"], a["Junctions"]) == (4, 4, 0) and a["ratio_branches"] == 1
    assert a["Soma_area"] > 400 and abs(a["Soma_aspect_ratio"] - 1) < 0.1 and (a["centre_r"], a["centre_c"]) == (60, 60)
    assert 84 <= a["Sholl_max_distance"] <= 87 and a["Sholl_circles"] == 7 and a["Sholl_crossing_processes"] == 16
    assert len(a["hull_corners"]) == 8 or len(a["hull_corners"]) == 4
    assert thin["Soma_area"] == 0 and thin["Sholl_circles"] is None and thin["Cell_area"] == 400 and thin["Convex_Hull_area"] == 400
    assert len(a) == 3 + 33 + 3


def test_neighbour_classes(spark):
    plus = {(10, c) for c in range(21)} | {(r, 10) for r in range(21)}
    kinds = {r["kind"]: r["count"] for r in raster.neighbour_class(table(spark, plus)).groupBy("kind").count().collect()}
    assert kinds == {"end": 4, "junction": 5, "path": 32}


def test_box_counts_of_a_full_image(spark):
    full = table(spark, [(r, c) for r in range(64) for c in range(64)])
    counts = raster.box_counts(full, (2, 4, 8, 16))
    assert {r["size"]: r["n"] for r in counts.collect()} == {2: 1024, 4: 256, 8: 64, 16: 16}
    assert raster.fractal_slope(counts).first()["slope"] == pytest.approx(-2)


def test_names(spark):
    names = ["R3_CNEURO-10_SCO_T7_CA1_FOTO1_PROCESSED.tif", "R7_VEH_SS_T10_HILUS.png", "odd.tif"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [[r[d] for d in text.DIMENSIONS] for r in df.select(*[text.image_dimension(df["name"], d).alias(d) for d in text.DIMENSIONS]).collect()]
    assert got == [["R3", "CNEURO-10", "SCO", "T7", "CA1"], ["R7", "VEH", "SS", "T10", "HILUS"], [None] * 5]
    box = spark.createDataFrame([("(10, 20)",)], "b string")
    with pytest.raises(Exception, match="not a box"):
        box.select(text.box_from_text(box["b"])).collect()


def test_ratio(spark):
    df = spark.createDataFrame([(3.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(df["a"], df["b"])).collect()] == [None, None, None, 0.5]
    ieee = [r[0] for r in df.select(ratio(df["a"], df["b"], ieee=True)).collect()]
    assert ieee[0] == math.inf and math.isnan(ieee[1]) and ieee[2] is None


def test_survival():
    for x in (0.1, 1.0, 5.0, 40.0):
        assert upper_gamma(1, x) == pytest.approx(math.exp(-x))
        assert upper_gamma(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)))


def blobs():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_spanning_forest(spark):
    points = blobs()
    df = spark.createDataFrame(points, "id long, vec array<double>")
    near = neighbors.knn(df, len(points) - 1, block=50)
    forest = neighbors.minimum_spanning_forest(near.select("src", "dst", near["d"].alias("w"))).collect()
    x = np.array([v for _, v in points])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inside, best, total = [0], d[0].copy(), 0.0
    while len(inside) < len(x):
        best[inside] = np.inf
        k = int(best.argmin())
        total += best[k]
        inside.append(k)
        best = np.minimum(best, d[k])
    assert len(forest) == len(points) - 1 and sum(r["w"] for r in forest) == pytest.approx(total)


def test_hdbscan(spark):
    found = clustering.hdbscan(spark.createDataFrame(blobs(), "id long, vec array<double>"), 10, 5, k=60).toPandas().sort_values("id")
    parts = [set(found["cluster"][i * 40 : i * 40 + 40]) - {-1} for i in range(3)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3 and (found["cluster"] == -1).mean() < 0.2


def test_recode_and_extensions(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    mapping = spark.createDataFrame([("a", "A")], "old string, new string")
    assert sorted(str(r["x"]) for r in facts.recode(df, "x", mapping).collect()) == ["A", "None", "b"]
    assert sorted(str(r["x"]) for r in facts.recode(df, "x", mapping, "null").collect()) == ["A", "None", "None"]
    files = spark.createDataFrame([("i", ".png"), ("i", ".TIF"), ("j", ".bmp")], "base string, extension string")
    assert [(r["base"], r["extension"]) for r in facts.first_extension(files).collect()] == [("i", ".TIF")]


def test_stream(spark, sf_dir, tmp_path):
    from somatrix.streaming import arrivals

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = arrivals.stream_parquet(spark, str(tmp_path / "in"), source.schema)
    arrivals.append_to(arrivals.windowed_counts(stream, "ts", "event_type"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.agg({"n": "sum"}).first()[0] <= source.count()


def test_images(spark, tmp_path):
    """Drawn images are read back by Spark's image source as the pixels they were drawn from."""
    from somatrix.sources import images, png

    size = spark.createDataFrame([("a", 12, 20), ("b", 5, 5)], "img string, h int, w int")
    pixels = spark.createDataFrame([("a", 3, 4, "255,128,0"), ("a", 11, 19, "1,2,3"), ("a", 40, 4, "9,9,9")], "img string, r int, c int, colour string")
    drawn = {r["img"]: bytes(r["png"]) for r in png.draw(pixels, size).collect()}
    name = tmp_path / "R3_VEH_SS_T7_CA1.png"
    name.write_bytes(drawn["a"])
    (tmp_path / "R3_VEH_SS_T8_CA1.png").write_bytes(drawn["b"])
    found = images.read_images(spark, str(tmp_path))
    assert {(r["height"], r["width"], r["tissue"], r["region"]) for r in found.collect()} == {(12, 20, "T7", "CA1"), (5, 5, "T8", "CA1")}
    coloured = images.channel(found, "rgba").filter("ch_a > 0").select("r", "c", "ch_r", "ch_g", "ch_b").collect()
    assert sorted(map(tuple, coloured)) == [(3, 4, 255, 128, 0), (11, 19, 1, 2, 3)]
    assert images.pixels(found, above=50, invert=False).select("r", "c").collect() == [(3, 4)]  # gray of 151 and of 2
    boxes = spark.createDataFrame([("a", 1, 1, 3, 4, "0,0,0")], "img string, top int, left int, height int, width int, colour string")
    assert png.annotations(boxes).count() == 10


def test_hdbscan_grid(spark):
    points = spark.createDataFrame(blobs()[:60], "id long, vec array<double>")
    found = clustering.hdbscan_grid(points, (5, 10), (4,))
    assert found.count() == 120 and found.select("min_cluster_size").distinct().count() == 2


def test_umap_grids(spark):
    """A layout for each pair of parameters, equal to that of its own table of neighbours, and a clustering of each."""
    points = spark.createDataFrame(blobs()[:40], "id long, vec array<double>")
    laid = clustering.umap_grid(points, (4, 6), (0.1,), epochs=1)
    assert laid.count() == 80 and {r["n_neighbors"] for r in laid.select("n_neighbors").distinct().collect()} == {4, 6}
    alone = {r["id"]: (r["umap_1"], r["umap_2"]) for r in clustering.umap_layout(points, 4, 0.1, epochs=1).collect()}
    assert all(alone[r["id"]] == pytest.approx((r["umap_1"], r["umap_2"])) for r in laid.filter("n_neighbors = 4").collect())
    found = clustering.umap_hdbscan_grid(points, (4,), (0.1,), (5, 8), (3,), epochs=1)
    assert found.count() == 80 and found.select("n_neighbors", "min_dist", "min_cluster_size", "min_samples").distinct().count() == 2


def test_feature_files(spark, tmp_path):
    from somatrix.sources import tables

    (tmp_path / "p.csv").write_text('Cell,cell_positions\n1,"(10, 20, 45, 78)"\n')
    assert tuple(tables.read_features(spark, str(tmp_path / "p.csv"), "Cell_Positions").first()["box"]) == (10, 20, 45, 78)
    facts_table = spark.createDataFrame([("CA1", "R1", 1), ("HILUS", "R1", 2)], "region string, subject string, cell int")
    tables.write_facts(facts_table, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).filter("region = 'CA1'").count() == 1


def test_exact_split(spark):
    """Ties, one order for many rows, and blocks far smaller than the table."""
    rows = spark.createDataFrame([(i, i % 3, i % 7) for i in range(2000)], "id long, order long, test_key long").repartition(3)
    for order in (F.col("order"), F.lit(5), F.col("id") * 1_000_003 % 5000 - 2500, F.when(F.col("id") < 5, F.lit(2**62)).otherwise(F.lit(-(2**63)))):
        found = selection.exact_split(rows, 0.3, "id", order=order, block=50).withColumn("by", order)
        assert found.count() == 2000 and found.filter("test").count() == 600 and found.columns == ["id", "order", "test_key", "test", "by"]
        assert found.filter("test").agg(F.max("by")).first()[0] <= found.filter("not test").agg(F.min("by")).first()[0]
    assert selection.exact_split(rows.limit(0), 0.3, "id").count() == 0


def test_free_names(spark):
    from somatrix.tables import free_names

    df = spark.createDataFrame([(1, 2)], "a int, _A int")
    assert free_names(df, "a", "b", "b") == ["__a", "b", "_b"]


def test_blend_of_all_pairs(spark):
    pairs = [(a, b) for a in range(256) for b in range(256)]
    got = raster.blend(spark.createDataFrame(pairs, "a int, b int"), "a", "b", 0.3).collect()
    exact = lambda a, b: int((Decimal(3 * a + 7 * b) / 10).quantize(Decimal(1), ROUND_HALF_EVEN))
    assert all(r["blended"] == exact(r["a"], r["b"]) for r in got) and len(got) == 65536


def test_numbered(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)] + [(None, -1)]
    got = facts.numbered(spark.createDataFrame(rows, "part int, before int").repartition(5), "part").collect()
    assert sorted((r["place"], r["part"]) for r in got) == [(1, None)] + [(k + 2, k) for k in range(1000)]
    assert facts.numbered(spark.createDataFrame([], "x int"), "x").count() == 0


def test_hull_by_its_mask():
    """The perimeter and axes of the filled hull's outline: of a disc, an ellipse and a triangle."""
    y, x = np.mgrid[-70:71, -70:71]
    of = lambda mask: measure.hull_shape(mask)
    disc, ellipse, triangle = x**2 + y**2 <= 625, (x / 60) ** 2 + (y / 30) ** 2 <= 1, (x >= 0) & (y >= 0) & (x + 3 * y <= 90)
    assert of(disc)["hull_perimeter"] == pytest.approx(164.9, abs=2) and of(disc)["hull_eccentricity"] == pytest.approx(1, abs=0.02)
    assert of(ellipse)["hull_perimeter"] == pytest.approx(303.6, abs=3) and of(ellipse)["hull_eccentricity"] == pytest.approx(0.5, abs=0.02)
    found = of(triangle)
    mask = measure.filled(measure.convex_hull(measure.outline(triangle)))
    assert found["hull_area"] == mask.sum() >= triangle.sum() and found["hull_perimeter"] == measure.length(measure.outline(mask))
    assert found["hull_eccentricity"] == measure.axis_ratio(measure.outline(mask)) > 0  # three corners have an ellipse too
    line = measure.hull_shape(np.ones((1, 9), bool))
    assert line["hull_area"] == 9 and line["hull_perimeter"] == 16
    assert measure.hull_shape(np.ones((1, 1), bool))["hull_area"] == 1
