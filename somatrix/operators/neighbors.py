"""Nearest neighbours and what is built on their graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from somatrix.operators.graph import components
from somatrix.tables import materialise

#: Blocks of rows where each then holds ``LEAST`` or more (blocks of columns are half as many), and the bytes of a block's vectors
#: beyond which there are more. A task holds a block of rows and one of columns, a copy of both, and a tile of their distances.
BLOCKS, LEAST, BLOCK_BYTES = 16, 640, 32 << 20
#: Rows of a tile, the columns of a search's first one and of any, and numbers that are subtracted at once.
ROWS, FIRST, COLUMNS, MEASURED = 512, 512, 4096, 1 << 22


def _blocks(n: int, width: int, block: int | None, most: int) -> int:
    """How many blocks ``n`` vectors of ``width`` numbers make: ``most`` as a rule; at most ``block`` vectors each, about, if that is given."""
    if block is not None:
        return max(1, -(-n // block))
    share = BLOCKS // most
    return max(1, min(most, -(-n // (LEAST * share))), -(-n // max(1, share * BLOCK_BYTES // (8 * max(1, width)))))


def _met(left: DataFrame, right: DataFrame, block: int | None) -> GroupedData:
    """Rows of both tables (id, vec, ...), grouped by a block of ``left`` and one of ``right``; ``side`` is 0 or 1. While blocks
    are below their bound their number is fixed, so that each row travels as often, however many there are."""
    size = F.count("*"), F.max(F.size("vec"))
    (m, wide), (n, width) = left.agg(*size).first(), right.agg(*size).first()
    rows, columns = _blocks(m, wide or 1, block, BLOCKS), _blocks(n, width or 1, block, BLOCKS // 2)
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = left.withColumn("a", own(rows)).withColumn("b", every(columns)).withColumn("side", F.lit(0))
    other = right.withColumn("a", every(rows)).withColumn("b", own(columns)).withColumn("side", F.lit(1))
    return one.unionByName(other).groupBy("a", "b")


def vectors(table: pa.Table) -> np.ndarray:
    """The column ``vec`` as a matrix."""
    flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(table.num_rows, -1)


class Tiles:
    """Squared distances between the rows of two matrices, tile by tile, by products in single precision where the numbers allow
    it, and a bound of what those round off. Both are moved by one vector first, which changes no distance."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, centre = x, y, x.mean(axis=0)
        left, right = x - centre, y - centre
        self.own, self.squares = (left**2).sum(axis=1), (right**2).sum(axis=1)
        self.kind = np.float32 if 1e-20 < max(self.own.max(), self.squares.max()) < 1e30 else np.float64
        self.left = np.column_stack([-2 * left, np.ones(len(x))]).astype(self.kind)
        self.right = np.column_stack([right, self.squares]).astype(self.kind)
        self.eps = (x.shape[1] + 16) * np.finfo(self.kind).eps

    def rough(self, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances less the rows' ``own``, and each row's bound of their error."""
        room = self.eps * (self.own[rows] + 2 * self.squares[columns].max()) + 1e-36
        return self.left[rows] @ self.right[columns].T, room

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        step = max(1, MEASURED // max(1, self.x.shape[1]))
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            out[part] = np.sqrt(((self.x[i[part]] - self.y[j[part]]) ** 2).sum(axis=1))
        return out


def _nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, of ``y``, and distances: the ``k`` nearest rows of ``y`` with another id of each row of ``x``, by distance
    and then id. ``others``, the ids of ``y``, ascend. A row's bound is the k-th distance found so far."""
    tiles, out = Tiles(x, y), []
    for at in range(0, len(x), ROWS):
        rows = slice(at, min(at + ROWS, len(x)))
        n = rows.stop - at
        limit = np.full(n, np.inf)
        i, j, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        start = stop = 0
        while stop < len(y):
            start, stop = stop, min(stop + min(COLUMNS, max(FIRST, stop)), len(y))  # as many again, with the bound found so far
            columns, wide = slice(start, stop), stop - start
            rough, room = tiles.rough(rows, columns)
            bound = limit - tiles.own[rows] + room
            begun = np.isposinf(limit)
            if begun.any() and wide > k:
                own = np.flatnonzero(begun)
                first = rough[own].copy()
                first[ids[rows][own, None] == others[columns]] = np.inf
                bound[own] = np.partition(first, k - 1, axis=1)[:, k - 1] + 2 * room[own]
            hit = np.flatnonzero(rough <= bound[:, None].astype(tiles.kind))
            if not len(hit):
                continue
            new_i, new_j = np.divmod(hit, wide)
            new_j += start
            apart = ids[at + new_i] != others[new_j]
            new_i, new_j = new_i[apart], new_j[apart]
            i, j, d = np.r_[i, new_i], np.r_[j, new_j], np.r_[d, tiles.exact(at + new_i, new_j)]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d, place = (v[place < k] for v in (i, j, d, place))
            last = place == k - 1
            limit[i[last]] = np.where(d[last] > 0, d[last] ** 2, -np.inf)  # those that follow have larger ids
        out.append((at + i, j, d))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def knn(points: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(src, dst, d, rank): the ``k`` nearest other points of each point of ``points`` (id, vec), by Euclidean distance and
    then id.

    Exact search compares all points, in blocks: the work is quadratic, no task holds more than two blocks. Each pair of blocks
    hands on at most ``k`` candidates a point, which a window then ranks. Rows that travel grow with the points, and with their
    square only once blocks have reached their bound (about a million points of 64 numbers)."""

    def nearest(rows: pa.Table) -> pa.Table:
        ours, theirs = (rows.filter(pc.equal(rows["side"], side)) for side in (0, 1))
        if not ours.num_rows or not theirs.num_rows:
            return pa.table([ours["id"][:0], theirs["id"][:0], pa.array([], pa.float64())], ["src", "dst", "d"])
        theirs = theirs.sort_by("id")
        ids, others = (side["id"].to_numpy() for side in (ours, theirs))
        i, j, d = _nearest(vectors(ours), ids, vectors(theirs), others, k)
        return pa.table([ours["id"].take(pa.array(i)), theirs["id"].take(pa.array(j)), pa.array(d)], ["src", "dst", "d"])

    kind, slim = dict(points.dtypes)["id"], points.select("id", "vec")
    candidates = _met(slim, slim, block).applyInArrow(nearest, f"src {kind}, dst {kind}, d double").repartition("src")
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst")))
    return ranked.filter(F.col("rank") <= k)


def core_distances(neighbours: DataFrame, samples: int) -> DataFrame:
    """(id, core): the distance to the ``samples``-th nearest point, the point itself counting as the first."""
    if samples < 2:
        return neighbours.select(F.col("src").alias("id"), F.lit(0.0).alias("core")).distinct()
    return neighbours.filter(F.col("rank") == samples - 1).select(F.col("src").alias("id"), F.col("d").alias("core"))


def mutual_reachability(neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    """(src, dst, w): the larger of the distance and both ends' core distances."""
    a = cores.select(F.col("id").alias("src"), F.col("core").alias("core_a"))
    b = cores.select(F.col("id").alias("dst"), F.col("core").alias("core_b"))
    return neighbours.join(a, "src").join(b, "dst").select("src", "dst", F.greatest("d", "core_a", "core_b").alias("w"))


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w): a minimum spanning forest of ``edges`` (src, dst, w), by Boruvka's rounds: each component takes its
    lightest edge to another, ties by the ends' ids, then components join over these. At most a logarithm of rounds."""
    kind = dict(edges.dtypes)["src"]
    undirected = edges.filter("src != dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("w").alias("w"))
    live = materialise(undirected.withColumn("cu", F.col("u")).withColumn("cv", F.col("v")), "edges")
    spark, taken = edges.sparkSession, None
    while not live.isEmpty():
        ends = live.select(F.col("cu").alias("c"), "u", "v", "w", "cu", "cv").unionByName(live.select(F.col("cv").alias("c"), "u", "v", "w", "cu", "cv"))
        best = ends.groupBy("c").agg(F.min_by(F.struct("u", "v", "w", "cu", "cv"), F.struct("w", "u", "v")).alias("e")).select("e.*").distinct()
        best = materialise(best, "chosen")
        taken = best.select("u", "v", "w") if taken is None else taken.unionByName(best.select("u", "v", "w"))
        roots = materialise(components(best.select("cu", "cv")), "roots")
        for c in ("cu", "cv"):
            live = live.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
        live = materialise(live.filter("cu != cv").select("u", "v", "w", "cu", "cv"), "edges")
    if taken is None:
        return spark.createDataFrame([], f"src {kind}, dst {kind}, w double")
    return taken.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")


def _lightest(ours: pa.Table, theirs: pa.Table) -> pd.DataFrame:
    """(u, v, w, part, other): of each part of ``ours`` (id, vec, core, part) its lightest edge to another part in ``theirs``."""
    tiles = Tiles(vectors(ours), vectors(theirs))
    core_x, id_x, of_x = (ours[c].to_numpy() for c in ("core", "id", "part"))
    core_y, id_y, of_y = (theirs[c].to_numpy() for c in ("core", "id", "part"))
    names, number = np.unique(np.r_[of_x, of_y], return_inverse=True)
    part_x, part_y = number[: len(of_x)], number[len(of_x) :]
    best, out = np.full(len(names), np.inf), [pd.DataFrame({"u": id_x[:0], "v": id_x[:0], "w": [], "part": of_x[:0], "other": of_x[:0]})]
    for at in range(0, len(id_x), ROWS):
        for start in range(0, len(id_y), COLUMNS):
            x, y = slice(at, min(at + ROWS, len(id_x))), slice(start, min(start + COLUMNS, len(id_y)))
            rough, room = tiles.rough(x, y)
            reach, least = core_y[y] ** 2, core_x[x] ** 2
            room = room + tiles.eps * np.maximum(least, reach.max())
            rough += tiles.own[x, None].astype(tiles.kind)
            np.maximum(rough, reach.astype(tiles.kind), out=rough)
            np.maximum(rough, least.astype(tiles.kind)[:, None], out=rough)
            rough[part_x[x, None] == part_y[y]] = np.inf
            limit = np.minimum(rough.min(axis=1) + room, best[part_x[x]] ** 2) + room  # a part's best edge so far bounds all its rows
            i, j = np.nonzero((rough <= limit.astype(tiles.kind)[:, None]) & np.isfinite(rough))
            i, j = i + at, j + start
            w = np.maximum(np.maximum(tiles.exact(i, j), core_x[i]), core_y[j])
            np.minimum.at(best, part_x[i], w)
            kept = w <= best[part_x[i]]
            i, j, w = i[kept], j[kept], w[kept]
            low = id_x[i] < id_y[j]
            found = pd.DataFrame({"u": np.where(low, id_x[i], id_y[j]), "v": np.where(low, id_y[j], id_x[i]), "w": w, "part": of_x[i], "other": of_y[j]})
            out.append(found.sort_values(["w", "u", "v"]).drop_duplicates("part"))
    return pd.concat(out[1:] or out).sort_values(["w", "u", "v"]).drop_duplicates("part")


def lightest_between(points: DataFrame, but: object = None, block: int | None = None) -> DataFrame:
    """(u, v, w, part, other): for each part of ``points`` (id, vec, core, part), ``but`` that one, its edge of least mutual
    reachability to another part, ties by the ends' ids, u < v. Exact: the points of these parts are compared with all, in
    blocks, as in ``knn``; each pair of blocks hands on one edge a part."""
    slim = points.select("id", "vec", "core", "part")

    def lightest(rows: pa.Table) -> pa.Table:
        ours, theirs = (rows.filter(pc.equal(rows["side"], side)) for side in (0, 1))
        kinds = [("u", rows["id"].type), ("v", rows["id"].type), ("w", pa.float64()), ("part", rows["part"].type), ("other", rows["part"].type)]
        if not ours.num_rows or not theirs.num_rows:
            return pa.schema(kinds).empty_table()
        return pa.Table.from_pandas(_lightest(ours, theirs), pa.schema(kinds), preserve_index=False)

    kind, part = dict(points.dtypes)["id"], dict(points.dtypes)["part"]
    asked = slim if but is None else slim.filter(F.col("part") != but)
    each = _met(asked, slim, block).applyInArrow(lightest, f"u {kind}, v {kind}, w double, part {part}, other {part}")
    return each.groupBy("part").agg(F.min(F.struct("w", "u", "v", "other")).alias("e")).select("e.u", "e.v", "e.w", "part", "e.other")


def spanning_tree(points: DataFrame, near: DataFrame, samples: int) -> DataFrame:
    """(src, dst, w): the minimum spanning forest of mutual reachability over ``near``, and where that leaves parts of
    ``points`` (id, vec) apart, the lightest edges that join them: rounds of an exact search among all points, each of which
    at least halves the parts. The largest part doesn't search: the others' edges join all parts as well, and only theirs
    are compared with all points."""
    cores = materialise(core_distances(near, samples), "cores")
    tree = materialise(minimum_spanning_forest(mutual_reachability(near, cores)), "forest")
    parts = components(tree.select("src", "dst")).select(F.col("node").alias("id"), F.col("root").alias("part"))
    known = points.select("id", "vec").join(cores, "id", "left").join(parts, "id", "left")
    known = materialise(known.select("id", "vec", F.coalesce("core", F.lit(0.0)).alias("core"), F.coalesce("part", "id").alias("part")), "parts")
    while known.select("part").distinct().limit(2).count() > 1:
        largest = known.groupBy("part").agg(F.count("*").alias("n")).agg(F.max_by("part", F.struct("n", "part"))).first()[0]
        best = materialise(lightest_between(known, largest), "lightest")
        tree = tree.unionByName(best.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").distinct())
        roots = components(best.select("part", "other")).withColumnRenamed("node", "part")
        known = materialise(known.join(roots, "part", "left").select("id", "vec", "core", F.coalesce("root", "part").alias("part")), "parts")
    return tree


def memberships(neighbours: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): each point's fuzzy membership of its neighbours: 1 up to the nearest one's distance, then falling so
    that a point's memberships sum to log2(k). Each point's distances are one array; a batch of arrays is solved at once."""

    @F.pandas_udf("array<double>")
    def smooth(distances: pd.Series) -> pd.Series:
        sizes = distances.map(len).to_numpy()
        there = np.arange(sizes.max()) < sizes[:, None]
        d = np.full(there.shape, np.inf)
        d[there] = np.concatenate(distances.to_numpy())
        near = np.where(d > 0, d, np.inf).min(axis=1)
        over, goal = np.maximum(d - np.where(np.isfinite(near), near, 0.0)[:, None], 0), np.log2(k)
        low, high, sigma, done = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.zeros(len(d), bool)
        for _ in range(64):
            total = np.exp(-over / sigma[:, None]).sum(axis=1)
            done |= np.abs(total - goal) < 1e-5
            if done.all():
                break
            low, high = np.where(~done & (total <= goal), sigma, low), np.where(~done & (total > goal), sigma, high)
            sigma = np.where(done, sigma, np.where(np.isfinite(high), (low + high) / 2, sigma * 2))
        mean = np.where(there, d, 0).sum(axis=1) / sizes
        w = np.exp(-over / np.maximum(sigma, 1e-3 * np.maximum(mean, 1e-12))[:, None])
        return pd.Series([row[:size] for row, size in zip(w, sizes, strict=True)])

    lists = neighbours.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d", "dst"))).alias("near"))
    solved = lists.withColumn("w", smooth(F.col("near.d")))
    return solved.select("src", F.explode(F.arrays_zip(F.col("near.dst").alias("dst"), F.col("w").alias("w"))).alias("x")).select("src", "x.dst", "x.w")


def fuzzy_union(directed: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the probabilistic sum of both directions' memberships."""
    ends = directed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), F.col("w")).otherwise(0.0).alias("p"), F.when(F.col("src") > F.col("dst"), F.col("w")).otherwise(0.0).alias("q"))
    both = ends.groupBy("a", "b").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    return both.select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w"))


def neighbourhood_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, jaccard): how far two neighbour tables agree on each point's neighbours."""
    marked = a.select("src", "dst", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("src", "dst", F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = marked.groupBy("src", "dst").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return each.groupBy(F.col("src").alias("id")).agg((F.sum(F.col("x") * F.col("y")) / F.count("*")).alias("jaccard"))


def local_dimension(points: DataFrame, near: DataFrame, share: float = 0.8, lists: int = 128) -> DataFrame:
    """(id, dimension): how many principal directions of a point's neighbourhood, itself included, hold ``share`` of its variance
    or more; 0 where all are copies. ``points`` is (id, vec), ``near`` a table of neighbours (src, dst). A task holds the
    neighbourhoods of about ``lists`` points; a point without neighbours in ``near`` has no row."""
    kind, groups = dict(points.dtypes)["id"], max(1, -(-near.select("src").distinct().count() // lists))
    whole = near.select("src", "dst").unionByName(near.select("src", F.col("src").alias("dst"))).distinct()
    placed = whole.join(points.select(F.col("id").alias("dst"), "vec"), "dst")

    def directions(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, part in rows.groupby("src")["vec"]:
            x = np.stack(part.to_numpy()).astype(np.float64)
            held = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
            total = held.sum()
            found.append((name, int(np.searchsorted(np.cumsum(held), share * total * (1 - 1e-12)) + 1) if total > 1e-24 * max(1.0, (x**2).sum()) else 0))
        return pd.DataFrame(found, columns=["id", "dimension"])

    at = F.pmod(F.xxhash64("src"), F.lit(groups)).alias("at")
    return placed.groupBy(at).applyInPandas(directions, f"id {kind}, dimension int")


def centroids(points: DataFrame, by: str, columns: tuple[str, ...], noise: int | None = -1) -> DataFrame:
    kept = points if noise is None else points.filter(F.col(by) != noise)
    return kept.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])
