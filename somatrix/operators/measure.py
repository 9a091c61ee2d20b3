"""Shape features of single cells.

A cell's crop is small, so its pixels are one group of a grouped Arrow operator, which measures them with numpy and hands
back one row of features. Everything between cells is left to Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The eight neighbours, clockwise from the east, as (row, column).
RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
CELL_FEATURES = ("area", "perimeter", "circularity", "compactness", "orientation", "feret_diameter", "eccentricity", "aspect_ratio")
HULL_FEATURES = ("hull_area", "hull_perimeter", "hull_compactness", "hull_eccentricity", "hull_feret_diameter", "hull_orientation")


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning (1984): both sub-iterations over the whole mask until nothing goes."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        before = m.sum()
        for first in (True, False):
            east, southeast, south, southwest, west, northwest, north, northeast = (np.roll(m, (-dr, -dc), (0, 1)) for dr, dc in RING)
            around = [north, northeast, east, southeast, south, southwest, west, northwest]
            count = sum(x.astype(np.int8) for x in around)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(around, around[1:] + around[:1], strict=True))
            sides = ~(north & east & south) & ~(east & south & west) if first else ~(north & east & west) & ~(north & south & west)
            m &= ~(m & (count >= 2) & (count <= 6) & (turns == 1) & sides)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of the component that holds the first foreground pixel, as (x, y) in order, by following it
    around; points inside straight runs are left out."""
    m = np.pad(mask.astype(bool), 1)
    if not m.any():
        return np.empty((0, 2), np.int64)
    at = first = tuple(int(x) for x in np.unravel_index(m.argmax(), m.shape))
    back, path, begun = 4, [first], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + RING[d][0], at[1] + RING[d][1])
            if m[to]:
                break
        else:
            break  # a single pixel
        if at == first and begun == d:
            path.pop()
            break
        begun = d if begun is None else begun
        at, back = to, (d + 4) % 8
        path.append(at)
    points = np.array(path)[:, ::-1] - 1
    if len(points) > 2:
        into, out = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
        points = points[(into != out).any(axis=1)]
    return points


def _components(mask: np.ndarray, eight: bool) -> np.ndarray:
    """The mask with a number above 0 for each of its components, ascending by their first pixels. Runs of pixels are joined,
    not pixels: there are far fewer."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), stop = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    width = mask.shape[1] + 2
    low = np.searchsorted(row * width + stop, (row + 1) * width + start - eight, "right")
    high = np.searchsorted(row * width + start, (row + 1) * width + stop + eight, "left")
    beside = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), beside)
    b = np.repeat(low - np.cumsum(beside) + beside, beside) + np.arange(len(a))
    root = np.arange(len(row))
    while True:  # every root hooks to the least root beside it, then all paths are halved
        one, other = root[a], root[b]
        least, most = np.minimum(one, other), np.maximum(one, other)
        if (least == most).all():
            break
        np.minimum.at(root, most, least)
        while (root != root[root]).any():
            root = root[root]
    numbered = np.zeros(mask.shape, np.int32)
    numbered[mask] = np.repeat(root + 1, stop - start)
    return numbered


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border of each component of the mask with its holes filled: what lies in a hole has none of its own."""
    around = _components(~np.pad(mask.astype(bool), 1), eight=False)
    numbered = _components((around != around[0, 0])[1:-1, 1:-1], eight=True)
    return [outline(numbered == k) for k in np.unique(numbered[numbered > 0])]


def length(points: np.ndarray) -> float:
    """Of the closed line through the points."""
    return float(np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum()) if len(points) > 1 else 0.0


def polygon_area(points: np.ndarray) -> float:
    x, y = points.T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2 if len(points) > 2 else 0.0


def centroid(points: np.ndarray) -> tuple[int, int] | None:
    """Of the polygon, truncated to whole pixels; None without an area."""
    x, y = points.T.astype(float)
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    area = cross.sum() / 2
    if len(points) < 3 or area == 0:
        return None
    return int(((x + np.roll(x, -1)) * cross).sum() / (6 * area)), int(((y + np.roll(y, -1)) * cross).sum() / (6 * area))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Andrew's monotone chain, counter-clockwise, without points inside its sides."""
    rows = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(rows) < 3:
        return np.array(rows).reshape(-1, 2)

    def half(ordered: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(rows) + half(rows[::-1]))


def least_rectangle(hull: np.ndarray) -> tuple[float, float]:
    """The longer side of the rectangle of least area around the hull, and its angle in degrees, above 0 and up to 90."""
    if len(hull) < 2:
        return 0.0, 90.0
    best = (math.inf, 0.0, 90.0)
    for dx, dy in np.roll(hull, -1, axis=0) - hull:
        angle = math.atan2(dy, dx) % (math.pi / 2)
        turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        w, h = np.ptp(hull @ turn, axis=0)
        best = min(best, (round(w * h, 9), max(w, h), math.degrees(angle) or 90.0))
    return best[1], best[2]


def axis_ratio(points: np.ndarray) -> float:
    """Shorter by longer axis of the ellipse fitted to the points by direct least squares (Fitzgibbon 1999, in the stable
    form of Halir and Flusser 1998); 0 for fewer than five points or no ellipse."""
    if len(points) < 5:
        return 0.0
    x, y = (points - points.mean(axis=0)).T / max(np.abs(points - points.mean(axis=0)).max(), 1e-9)
    quadratic, linear = np.column_stack([x * x, x * y, y * y]), np.column_stack([x, y, np.ones_like(x)])
    s2, s3 = quadratic.T @ linear, linear.T @ linear
    if abs(np.linalg.det(s3)) < 1e-12:
        return 0.0
    t = -np.linalg.solve(s3, s2.T)
    reduced = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (quadratic.T @ quadratic + s2 @ t)
    _, vectors = np.linalg.eig(reduced)
    vectors = np.real(vectors)
    inside = 4 * vectors[0] * vectors[2] - vectors[1] ** 2
    if inside.max() <= 0:
        return 0.0
    a, b, c = vectors[:, inside.argmax()]
    spread = math.hypot(a - c, b)
    low, high = abs(a + c) - spread, abs(a + c) + spread
    return math.sqrt(max(low, 0.0) / high) if high > 0 else 0.0


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification of a closed line."""
    if len(points) < 3:
        return points
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    keep = np.zeros(len(points) + 1, bool)
    closed = np.vstack([points, points[:1]])
    keep[[0, far, len(points)]] = True
    stack = [(0, far), (far, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, rest = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        size = math.hypot(*line)
        d = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
        if d.max() > tolerance:
            k = a + 1 + int(d.argmax())
            keep[k] = True
            stack += [(a, k), (k, b)]
    return points[keep[:-1]]


def filled(hull: np.ndarray) -> np.ndarray:
    """The mask of a convex polygon, its corner of least x and y at the border: whole pixels inside it, and those that its
    sides, drawn as lines, run through."""
    x, y = (hull - hull.min(axis=0)).T
    low, high = np.full(y.max() + 1, math.inf), np.full(y.max() + 1, -math.inf)
    for x1, y1, x2, y2 in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True):
        n = int(max(abs(x2 - x1), abs(y2 - y1), 1))
        at = np.arange(n + 1) / n
        across, down = np.floor(x1 + at * (x2 - x1) + 0.5), np.floor(y1 + at * (y2 - y1) + 0.5).astype(int)
        np.minimum.at(low, down, across)
        np.maximum.at(high, down, across)
    columns = np.arange(x.max() + 1)
    return (columns >= low[:, None]) & (columns <= high[:, None])


def ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def shape(mask: np.ndarray) -> dict[str, float]:
    """``CELL_FEATURES`` of the mask; all 0 for an empty one. Eccentricity is the fitted ellipse's axis ratio. The
    perimeter is that of all outlines, the rest is of the one around the largest area (of equal ones the first)."""
    area = int(mask.sum())
    if not area:
        return dict.fromkeys(CELL_FEATURES, 0.0)
    lines = outlines(mask)
    line = max(lines, key=polygon_area)
    perimeter = sum(map(length, lines))
    feret, angle = least_rectangle(convex_hull(line))
    width, height = np.ptp(line, axis=0) + 1
    return dict(zip(CELL_FEATURES, (float(area), perimeter, ratio(4 * math.pi * area, perimeter**2), ratio(area, perimeter), angle, feret, axis_ratio(line), width / height), strict=True))


def hull_shape(mask: np.ndarray) -> dict[str, float]:
    """``HULL_FEATURES``: those of the outline of the filled hull of the mask's largest outline, as the published ones."""
    if not mask.any():
        return dict.fromkeys(HULL_FEATURES, 0.0)
    whole = filled(convex_hull(max(outlines(mask), key=polygon_area)))
    line = outline(whole)
    feret, angle = least_rectangle(convex_hull(line))
    area, perimeter = int(whole.sum()), length(line)
    return dict(zip(HULL_FEATURES, (float(area), perimeter, ratio(area, perimeter), axis_ratio(line), feret, angle), strict=True))


def measure(pixels: DataFrame) -> DataFrame:
    """One row for each cell of ``pixels`` (img, cell, r, c): its shape, its hull's, its skeleton's size, the centroid of its
    largest outline (``centre_r``, ``centre_c``, null without an area) and the corners of its hull's approximation within 0.02 of the
    hull's perimeter (``hull_corners``), all in the coordinates of ``pixels``.

    A cell without pixels has no row. ``flag`` says why features are 0: few points for an ellipse, or no outline."""
    kinds = dict(pixels.dtypes)
    names = [*CELL_FEATURES, *HULL_FEATURES, "solidity", "convexity", "skeleton_area"]

    types = ", ".join(f"{n} double" for n in names)
    corner = pa.list_(pa.struct([("r", pa.int64()), ("c", pa.int64())]))

    def one(cell: pa.Table) -> pa.Table:
        r, c = cell["r"].to_numpy(), cell["c"].to_numpy()
        mask = np.zeros((np.ptp(r) + 1, np.ptp(c) + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        row = shape(mask) | hull_shape(mask)
        row["solidity"], row["convexity"] = ratio(row["area"], row["hull_area"]), ratio(row["perimeter"], row["hull_perimeter"])
        row["skeleton_area"] = float(thin(mask).sum())
        line = max(outlines(mask), key=polygon_area)
        centre = centroid(line)
        row["centre_c"], row["centre_r"] = (None, None) if centre is None else (int(centre[0] + c.min()), int(centre[1] + r.min()))
        corners = simplify(convex_hull(line), 0.02 * row["hull_perimeter"])
        row["hull_corners"] = [{"r": int(y + r.min()), "c": int(x + c.min())} for x, y in corners]
        flag = "few points" if row["eccentricity"] == 0 else None
        schema = pa.schema([*[(n, pa.float64()) for n in names], ("centre_r", pa.int64()), ("centre_c", pa.int64()), ("hull_corners", corner), ("flag", pa.string())])
        found = pa.Table.from_pylist([row | {"flag": flag}], schema)
        return found.add_column(0, "cell", cell["cell"].slice(0, 1)).add_column(0, "img", cell["img"].slice(0, 1))

    return pixels.groupBy("img", "cell").applyInArrow(one, f"img {kinds['img']}, cell {kinds['cell']}, {types}, centre_r long, centre_c long, hull_corners array<struct<r: long, c: long>>, flag string")


def skeletons(pixels: DataFrame) -> DataFrame:
    """(key, r, c): the thinned pixels of each cell of ``pixels`` (key, r, c). Keys, which may be structs, stay Arrow's: as
    Python's objects, one a pixel, they would take far more room than the picture."""
    kind = dict(pixels.dtypes)["key"]

    def one(cell: pa.Table) -> pa.Table:
        r, c = cell["r"].to_numpy(), cell["c"].to_numpy()
        mask = np.zeros((np.ptp(r) + 1, np.ptp(c) + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        left_r, left_c = np.nonzero(thin(mask))
        key = cell["key"].slice(0, 1)
        if pa.types.is_struct(key.type):
            key = key.cast(pa.struct([part.with_nullable(True) for part in key.type]))
        key = key.take(pa.array(np.zeros(len(left_r), np.int64)))
        return pa.table([key, pa.array((left_r + r.min()).astype(np.int64)), pa.array((left_c + c.min()).astype(np.int64))], ["key", "r", "c"])

    return pixels.groupBy("key").applyInArrow(one, f"key {kind}, r long, c long")
