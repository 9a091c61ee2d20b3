"""Two drawn micrographs, from files to facts and to files again."""

import numpy as np
from pyspark.sql import functions as F

from somatrix.sources import files, folder, images, png


def micrograph(cells):
    """Dark cells on white: discs, each with straight arms of three pixels' width in as many directions as asked for."""
    y, x = np.mgrid[:200, :300]
    picture = np.full((200, 300), 255, np.uint8)
    for r, c, radius, arms in cells:
        picture[(y - r) ** 2 + (x - c) ** 2 <= radius**2] = 0
        for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))[:arms]:
            along = (y - r) * dr + (x - c) * dc
            across = np.abs((y - r) * dc - (x - c) * dr)
            picture[(along >= 0) & (along <= radius + 28) & (across <= 1)] = 0
    picture[2:5, 2:5] = 0  # too small for a cell
    return picture[:, :, None]


def test_from_folder_to_facts_and_crops(spark, tmp_path):
    drawn = {"R3_VEH_SS_T7_CA1.tif": [(60, 70, 9, 4), (140, 220, 11, 2)], "R4_CNO_SS_T7_HILUS_FOTO1_PROCESSED.tif": [(90, 150, 10, 3)], "other.tif": [(90, 150, 8, 1)]}
    for name, cells in drawn.items():
        (tmp_path / name).write_bytes(files.encode_tiff(micrograph(cells)))
    (tmp_path / "broken.tif").write_bytes(b"no picture")
    options = {"least": 100, "iterations": 2, "frame": 2, "spur": 5, "sizes": (2, 4, 8, 16), "first": 15, "step": 5}
    found = folder.folder_facts(spark, str(tmp_path), "*.tif", **options).orderBy("image", "Cell").cache()
    rows = found.collect()
    assert [(r["image"], r["Cell"], r["Cell_ID"], r["categories"]) for r in rows] == [
        ("R3_VEH_SS_T7_CA1.tif", 1, "C1_CA1_VEH_SS_T7_R3", "VEH_SS_CA1"),
        ("R3_VEH_SS_T7_CA1.tif", 2, "C2_CA1_VEH_SS_T7_R3", "VEH_SS_CA1"),
        ("R4_CNO_SS_T7_HILUS_FOTO1_PROCESSED.tif", 1, "C1_HILUS_CNO_SS_T7_R4", "CNO_SS_HILUS"),
        ("other.tif", 1, None, None),
    ]
    assert [r["subject"] for r in rows] == ["R3", "R3", "R4", None]
    assert [r["cell_positions"] for r in rows][:2] == ["(33, 23, 108, 98)", "(181, 129, 260, 152)"]
    for r, arms, radius in zip(rows, (4, 2, 3, 1), (9, 11, 10, 8), strict=True):
        assert abs(r["Soma_area"] / (np.pi * radius**2) - 1) < 0.15
        assert r["Initial_Points"] == r["End_Points"] == r["Branches"] == arms, r
        # rings within the arms' length are crossed once by each arm
        assert r["Sholl_crossing_processes"] >= arms * ((radius + 24 - 15) // 5)
        assert 0 < r["Convex_Hull_eccentricity"] <= 1 and r["Fractal_dimension"] < 0
        assert r["Cell_solidity"] < 1 or arms == 0
    assert [r["path"].rsplit("/", 1)[1] for r in images.unreadable(spark, str(tmp_path), "*.tif").collect()] == ["broken.tif"]
    assert folder.folder_facts(spark, str(tmp_path), "*.png", **options).count() == 0
