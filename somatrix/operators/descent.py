"""Approximate nearest neighbours: slices along random directions give a start, descent over neighbours of neighbours the rest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somatrix.operators.neighbors import vectors
from somatrix.tables import materialise, release

#: Points in a slice at most, about; slices that each one is cut into; lists of neighbours that a task compares at once.
LEAF, FAN, LISTS = 256, 8, 128
#: Pairs whose vectors are subtracted at once.
PAIRS = 1 << 14
#: Up to so many slices their cuts are broadcast (7 numbers each); with more, none holds many rows and cuts are joined by a shuffle.
BROADCAST_SLICES = 100_000


def approximate_knn(points: DataFrame, k: int, trees: int = 3, rounds: int = 12, settled: float = 0.001, seed: int = 24) -> DataFrame:
    """(src, dst, d, rank): ``k`` near other points of each point of ``points`` (id, vec), by distance and then id; fewer where
    there aren't as many points. Most are the nearest ones, which ``neighbors.knn`` finds exactly.

    Each of ``trees`` forests of slices compares points that lie close along a few random directions. Then, in rounds, the points
    of each list (a point's neighbours and the ``k`` nearest that have it as theirs) are compared among themselves, pairs that
    were together before left out. Lists are half as long again as ``k``, by 5 at least, which are dropped at the end. Rounds end when no more than ``settled`` of all neighbours changed. The work of a start and of
    a round grows with the points, not with their square; a task holds one slice or ``LISTS`` lists. Copies in any number are dealt
    over slices by their ids, and count as neighbours at distance 0. Vectors have one length, without null or NaN."""
    kind, first = dict(points.dtypes)["id"], points.select("vec").first()
    if first is None:
        return points.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, d double, rank int")
    points = materialise(points.select("id", "vec"), "points")
    n, wanted, k = points.count(), k, k + max(5, k // 2)
    sliced = _slices(points, n, len(first["vec"]), trees, max(LEAF, 2 * FAN * k), seed)
    found = sliced.groupBy("tree", "slice").applyInPandas(lambda rows: _nearest(rows, k), f"src {kind}, dst {kind}, d double")
    state = materialise(_ranked(found.withColumn("fresh", F.lit(True)), k), "neighbours")
    release(sliced)
    for _ in range(rounds):
        fresh = _ranked(state.select("src", "dst", "d", F.lit(False).alias("fresh")).unionByName(_compared(points, state, k, n)), k)
        earlier, state = state, materialise(fresh, "neighbours")
        release(earlier)
        if state.filter("fresh").count() <= settled * k * n:
            break
    return state.filter(F.col("rank") <= wanted).select("src", "dst", "d", "rank")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each point; what was there before isn't fresh."""
    once = pairs.repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).filter(F.col("rank") <= k)


def _slices(points: DataFrame, n: int, length: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(tree, slice, id, vec): each tree cuts all points along one random direction a level, at ``FAN - 1`` quantiles of each
    slice. A shift by a billionth, from the id, tells copies apart."""
    levels = max(0, math.ceil(math.log(n / leaf, FAN))) if n > leaf else 0
    directions = np.random.default_rng(seed).standard_normal((length, trees * levels))

    @F.pandas_udf("array<double>")
    def along(vecs: pd.Series, shift: pd.Series) -> pd.Series:
        at = np.stack(vecs.to_numpy()).astype(np.float64) @ directions
        return pd.Series(list(at + shift.to_numpy()[:, None] * 1e-9 * (1 + np.abs(at))))

    shift = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = points.withColumn("along", along("vec", shift)) if levels else points.withColumn("along", F.array(F.lit(0.0)))
    rows = placed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1 if levels else 0)))).withColumn("slice", F.lit(0).cast("long"))
    rows = materialise(rows, "slices")
    for level in range(levels):
        rows = rows.withColumn("at", F.get("along", F.col("tree") * levels + level))
        cuts = rows.groupBy("tree", "slice").agg(F.percentile_approx("at", [i / FAN for i in range(1, FAN)], 1000).alias("cuts"))
        cuts = F.broadcast(cuts) if trees * FAN**level <= BROADCAST_SLICES else cuts
        part = F.size(F.filter("cuts", lambda x: x < F.col("at")))
        cut = rows.join(cuts, ["tree", "slice"]).withColumn("slice", F.col("slice") * FAN + part).drop("cuts", "at")
        earlier, rows = rows, materialise(cut, "slices")
        release(earlier)
    return rows.drop("along")


def _nearest(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each point within a slice."""
    rows = rows.sort_values("id")
    ids, x = rows["id"].to_numpy(), np.stack(rows["vec"].to_numpy()).astype(np.float64)
    squares, out = (x**2).sum(axis=1), [pd.DataFrame({"src": ids[:0], "dst": ids[:0], "d": []})]
    most = min(k, len(x) - 1)
    for at in range(0, len(x) if most > 0 else 0, 256):
        part = x[at : at + 256]
        rough = squares[at : at + 256, None] + squares - 2 * part @ x.T
        rough[ids[at : at + 256, None] == ids] = np.inf
        j = np.argpartition(rough, most - 1, axis=1)[:, :most].ravel()
        i = np.repeat(np.arange(len(part)), most)
        kept = ids[at + i] != ids[j]
        i, j = i[kept], j[kept]
        out.append(pd.DataFrame({"src": ids[at + i], "dst": ids[j], "d": np.sqrt(((part[i] - x[j]) ** 2).sum(axis=1))}))
    return pd.concat(out[1:] or out)


def _compared(points: DataFrame, state: DataFrame, k: int, n: int) -> DataFrame:
    """(src, dst, d, fresh): pairs from within each point's list that are nearer than the farthest neighbour kept so far."""
    kind = dict(state.dtypes)["src"]
    back = state.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d", "fresh")
    back = back.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).filter(F.col("place") <= k)
    lists = state.select("src", "dst", "fresh").unionByName(back.select("src", "dst", "fresh")).groupBy("src", "dst").agg(F.max("fresh").alias("fresh"))
    reach = state.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("reach"))
    members = points.join(reach, "id", "left").select(F.col("id").alias("dst"), "vec", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    at = F.pmod(F.xxhash64("src"), F.lit(max(1, -(-n // LISTS)))).alias("at")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("src", "ascending"), ("dst", "ascending")])
        of, ids, reach, fresh = (rows[c].to_numpy() for c in ("src", "dst", "reach", "fresh"))
        x, none = vectors(rows), np.empty(0, np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found_i, found_j = [none], [none]
        for low, size in zip(starts, np.diff(np.r_[starts, len(of)]), strict=True):
            i, j = pairs[size] = pairs.get(size) or np.triu_indices(size, 1)
            i, j = low + i, low + j
            new = fresh[i] | fresh[j]
            found_i.append(i[new])
            found_j.append(j[new])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        d = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            part = slice(at, at + PAIRS)
            d[part] = np.sqrt(((x[i[part]] - x[j[part]]) ** 2).sum(axis=1))
        nearer = np.r_[d < reach[i], d < reach[j]]
        a, b, d = np.r_[i, j][nearer], np.r_[j, i][nearer], np.r_[d, d][nearer]
        found = pd.DataFrame({"src": ids[a], "dst": ids[b], "d": d}).drop_duplicates(["src", "dst"])
        kinds = [("src", rows["dst"].type), ("dst", rows["dst"].type), ("d", pa.float64())]
        return pa.Table.from_pandas(found, pa.schema(kinds), preserve_index=False)

    compared = lists.join(members, "dst").groupBy(at).applyInArrow(compare, f"src {kind}, dst {kind}, d double")
    return compared.withColumn("fresh", F.lit(True))
