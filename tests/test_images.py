"""Image files out and in again, files that are no images, and what is drawn over images."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somatrix.operators import measure, raster
from somatrix.sources import files, images, png
from somatrix.streaming import arrivals


def test_written_files_are_read_back(spark, tmp_path):
    """TIFF and PNG crops in the colours of their clusters, through the writer and Spark's image source."""
    boxes = spark.createDataFrame([("R3_VEH_SS_T7_CA1", 1, 10, 20, 4, 5), ("R3_VEH_SS_T7_CA1", 2, 0, 0, 200, 300)], "img string, cell int, top int, left int, height int, width int")
    cells = spark.createDataFrame([("R3_VEH_SS_T7_CA1", 1, 11, 22), ("R3_VEH_SS_T7_CA1", 1, 13, 24), ("R3_VEH_SS_T7_CA1", 2, 199, 299)], "img string, cell int, r int, c int")
    colours = spark.createDataFrame([("R3_VEH_SS_T7_CA1", 1, "255,128,0")], "img string, cell int, colour string")
    for kind in ("tif", "png"):
        folder = tmp_path / f"{kind} files"
        crops = png.coloured_crops(cells, boxes, colours, kind)
        files.write_images(crops, str(folder))
        files.write_images(crops, str(folder))  # again: replaced
        assert sorted(p.name for p in folder.iterdir()) == [f"R3_VEH_SS_T7_CA1_cell_{k}.{kind}" for k in (1, 2)]
        found = images.read_images(spark, str(folder))
        assert sorted((r["height"], r["width"], r["channels"]) for r in found.collect()) == [(4, 5, 4), (200, 300, 4)]
        shown = images.channel(found, "rgba").filter("ch_a > 0").select("r", "c", "ch_r", "ch_g", "ch_b", "ch_a").collect()
        assert sorted(map(tuple, shown)) == [(1, 2, 255, 128, 0, 255), (3, 4, 255, 128, 0, 255), (199, 299, 128, 128, 128, 255)]
        assert images.unreadable(spark, str(folder)).isEmpty()


def test_names_of_files(spark, tmp_path):
    for rows in ([("a.tif", b"x"), ("a.tif", b"y")], [(None, b"x")]):
        with pytest.raises(ValueError, match="once"):
            files.write_images(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_tiff(spark, tmp_path, channels):
    """Every byte comes back, over several strips and from odd sizes."""
    picture = np.random.default_rng(channels).integers(0, 256, (301, 257, channels), np.uint8)
    (tmp_path / "x.tif").write_bytes(files.encode_tiff(picture))
    row = images.read_images(spark, str(tmp_path)).first()
    back = np.frombuffer(row["data"], np.uint8).reshape(301, 257, -1)
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    assert (back[:, :, order] == picture).all()


def test_broken_files_and_gray(spark, tmp_path):
    picture = np.zeros((3, 3, 3), np.uint8)
    picture[0, 0], picture[1, 1], picture[2, 2] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    whole, noise = png.encode(picture), np.random.default_rng(1).integers(0, 256, (300, 300, 3), np.uint8)
    for name, content in (("good one.png", whole), ("cut.png", png.encode(noise)[:5000]), ("text.tif", b"no picture"), ("empty.jpg", b""), ("other.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    lost = {r["path"].rsplit("/", 1)[1] for r in images.unreadable(spark, str(tmp_path)).collect()}
    assert lost == {"cut.png", "text.tif", "empty.jpg"}
    found = images.read_images(spark, str(tmp_path))
    at = {level: sorted(tuple(r)[1:] for r in images.pixels(found, level, invert=False).collect()) for level in (28, 29, 75, 76, 149, 150)}
    assert at == {28: [(0, 0), (1, 1), (2, 2)], 29: [(0, 0), (1, 1)], 75: [(0, 0), (1, 1)], 76: [(1, 1)], 149: [(1, 1)], 150: []}


def test_numbers(spark):
    """Each digit differs from the others, and a number's digits stand side by side."""
    boxes = spark.createDataFrame([("a", 1023456789, 5, 7, "1,1,1")], "img string, cell long, top int, left int, colour string")
    drawn = np.zeros((40, 120), int)
    for r in png.numbers(boxes, 2).collect():
        drawn[r["r"], r["c"]] += 1
    digits = [drawn[7:17, 9 + 8 * k : 15 + 8 * k] for k in range(10)]
    assert drawn.max() == 1 and sum(d.sum() for d in digits) == drawn.sum() and len({d.tobytes() for d in digits}) == 10


def test_image_arrivals(spark, tmp_path):
    """Two batches give the counts of one look at all files; a file that is no picture counts as a file."""
    import os

    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def put(name, minute):
        (folder / name).write_bytes(b"x")
        os.utime(folder / name, (1_700_000_000 + 60 * minute,) * 2)

    def run():
        arrivals.append_to(arrivals.windowed_counts(arrivals.stream_images(spark, str(folder)), "modificationTime", "region", "10 minutes"), out, state).awaitTermination()

    for k in range(3):
        put(f"R3_VEH_SS_T{k}_CA1.tif", k)
    run()
    put("R3_VEH_SS_T4_CA1.tif", 3)  # late, inside the watermark
    put("R3_VEH_SS_T5_HILUS.tif", 30)
    put("R3_VEH_SS_T6_HILUS.tif", 300)
    run()
    found = {(r["region"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert ("CA1", 4) in found


def test_components_of_runs_take_little_memory():
    """Numbers follow first pixels, as by single pixels, in a tenth of their room."""
    rng = np.random.default_rng(6)
    for density in (0.0, 0.4, 0.6, 0.9, 1.0):
        mask = rng.random((17, 23)) < density
        for eight in (True, False):
            r, c = np.nonzero(mask)
            wanted = raster.label_square(pd.DataFrame({"r": r, "c": c}), eight) if len(r) else np.empty(0, int)
            found = measure._components(mask, eight)[mask]
            assert (np.unique(found, return_inverse=True)[1] == np.unique(wanted, return_inverse=True)[1]).all()
    whole = np.ones((600, 600), bool)
    tracemalloc.start()
    assert len(measure.outlines(whole)) == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * whole.size


def test_cells_with_struct_keys_stay_in_arrow(spark):
    key = F.struct(F.lit("a").alias("img"), F.col("cell"))
    pixels = spark.range(60).select((F.col("id") % 2).alias("cell"), F.expr("id div 10").alias("r"), (F.col("id") % 10).alias("c"))
    thinned = measure.skeletons(pixels.select(key.alias("key"), "r", "c"))
    assert "FlatMapGroupsInArrow" in thinned._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r["key"]) for r in thinned.collect()} == {("a", 0), ("a", 1)}
    assert "FlatMapGroupsInArrow" in measure.measure(pixels.withColumn("img", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
