"""Moving the points of a layout, all at once in each epoch, block by block."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatrix.tables import materialise, release

#: Blocks where each then holds ``LEAST`` points or more; beyond ``MOST`` points a block there are more blocks. Epochs of one plan.
BLOCKS, LEAST, MOST, EPOCHS = 16, 640, 1 << 16, 10

HELD = "block int, key array<long>, head array<int>, tail array<long>, w array<double>"
SENT = "block int, sender int, x array<double>, y array<double>, asked array<long>"


def hashed(key: np.ndarray, value: np.ndarray | int) -> np.ndarray:
    """``xxhash64`` of what hashed to ``key`` and one more int column."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (key + p5 + np.uint64(4)) ^ (np.asarray(value, np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


class Rule:
    """What moves points: ``negatives`` of the ``n`` points are drawn for each one and epoch. Point ``slot`` is at a place that
    counts through the blocks, which are dealt slots in turn."""

    def __init__(self, n: int, a: float, b: float, seed: int, epochs: int, negatives: int):
        self.n, self.a, self.b, self.seed, self.epochs, self.negatives = n, a, b, seed, epochs, negatives
        self.blocks = max(1, min(BLOCKS, -(-n // LEAST)), -(-n // MOST))
        self.size = -(-n // self.blocks)

    def place(self, slot):
        """Also of a column."""
        whole = F.floor(slot / self.blocks) if not isinstance(slot, np.ndarray) else slot // self.blocks
        return slot % self.blocks * self.size + whole

    def drawn(self, key: np.ndarray, epoch: int) -> np.ndarray:
        """Places of the points from which those of ``key`` are pushed, a row for each draw."""
        each = hashed(hashed(key.view(np.uint64), self.seed + epoch), np.arange(self.negatives)[:, None])
        return self.place(each.view(np.int64) % self.n)

    def needed(self, own: np.ndarray, key: np.ndarray, tail: np.ndarray, epoch: int) -> np.ndarray:
        """Places, ascending, that a block reads in an epoch: its own, and if points move then, those that they meet."""
        if not 0 <= epoch < self.epochs:
            return own
        met = np.sort(np.concatenate([own, tail, self.drawn(key, epoch).ravel()]))
        return met[np.r_[True, met[1:] != met[:-1]]]

    def moved(self, xy: np.ndarray, needed: np.ndarray, own: np.ndarray, key: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, epoch: int) -> np.ndarray:
        """Where the block's points are after an epoch. ``xy`` has the points at ``needed``."""
        a, b, at = self.a, self.b, xy[np.searchsorted(needed, own)]
        apart = at[head] - xy[np.searchsorted(needed, tail)]
        dd = (apart**2).sum(axis=1)
        g = w * -2 * a * b * np.maximum(dd, 1e-9) ** (b - 1) / (1 + a * dd**b)
        moves = np.column_stack([np.bincount(head, g * apart[:, c], len(own)) for c in (0, 1)]).astype(float)
        for others in self.drawn(key, epoch):
            apart = at - xy[np.searchsorted(needed, others)]
            dd = (apart**2).sum(axis=1)
            h = np.where(others == own, 0.0, 2 * b / ((0.001 + dd) * (1 + a * dd**b)))
            moves += np.clip(h[:, None] * apart, -4, 4)
        return at + (1 - epoch / self.epochs) * np.clip(moves, -4, 4)

    def parts(self, places: np.ndarray) -> dict[int, np.ndarray]:
        """Ascending places by block."""
        blocks = np.arange(places[0] // self.size, places[-1] // self.size + 1)
        pieces = np.split(places, np.searchsorted(places, blocks[1:] * self.size))
        return {k: v for k, v in zip(blocks.tolist(), pieces, strict=True) if len(v)}


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    """All elements of a column of lists."""
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    """A row for each array."""
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), np.concatenate(values))


def _rows(sender: int, given: dict[int, np.ndarray], asked: dict[int, np.ndarray]) -> pa.Table:
    """A row for each block that is given positions, or asked for some."""
    to, none = sorted(given.keys() | asked.keys()), np.empty((0, 2))
    xy = [given.get(k, none) for k in to]
    lists = [[v[:, 0] for v in xy], [v[:, 1] for v in xy], [asked.get(k, none[:, 0].astype(np.int64)) for k in to]]
    return pa.table([pa.array(to, pa.int32()), pa.array([sender] * len(to), pa.int32()), *map(_lists, lists)], ["block", "sender", "x", "y", "asked"])


def _pack(key: tuple, points: pa.Table, edges: pa.Table) -> pa.Table:
    """A block's points in order of their places, and its edges in order of both ends (looked up fastest so), as one row."""
    points, edges = points.sort_by("place"), edges.sort_by([("tail", "ascending"), ("head", "ascending")])
    values = [points["key"], edges["head"], edges["tail"], edges["w"], points["x"], points["y"]]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *[_lists([v.to_numpy()]) for v in values]], ["block", "key", "head", "tail", "w", "x", "y"])


def _begin(batches, rule: Rule):
    """Each block keeps its positions and asks others for those that epoch 0 needs."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(k, 1)])
            block, key, tail = row["block"][0].as_py(), _numbers(row, "key"), _numbers(row, "tail")
            own = block * rule.size + np.arange(len(key))
            xy = np.column_stack([_numbers(row, "x"), _numbers(row, "y")])
            yield from _rows(block, {block: xy}, rule.parts(rule.needed(own, key, tail, 0))).to_batches()


def _step(held: pa.Table, sent: pa.Table, rule: Rule, epoch: int) -> pa.Table:
    """A block's points move; it gives others the new positions that they asked for, and asks for those that the epoch after the
    next one needs. What came from each block is in order of places. Before epoch 0 positions are only given."""
    block, key, head, tail, w = held["block"][0].as_py(), *[_numbers(held, c) for c in ("key", "head", "tail", "w")]
    own = block * rule.size + np.arange(len(key))
    sent = sent.sort_by("sender")
    xy = np.column_stack([_numbers(sent, "x"), _numbers(sent, "y")])
    if epoch >= 0:
        xy = rule.moved(xy, rule.needed(own, key, tail, epoch), own, key, head, tail, w, epoch)
    wanted = dict(zip(sent["sender"].to_pylist(), (v.values.to_numpy() - own[0] for v in sent["asked"]), strict=True))
    return _rows(block, {k: xy[v] for k, v in wanted.items() if len(v)}, rule.parts(rule.needed(own, key, tail, epoch + 2)))


def descend(points: DataFrame, edges: DataFrame, n: int, a: float, b: float, seed: int, epochs: int, negatives: int) -> DataFrame:
    """(slot, x, y) after all epochs, from ``points`` (slot, key, x, y), slots counting from 0 to ``n`` - 1, and ``edges`` (src,
    dst, w) between slots, each in both directions.

    A task holds a block of points with their edges, which stay where they are, and the points that these meet in an epoch: so
    rows that travel in an epoch grow with the points and edges, one row for each pair of blocks."""
    rule = Rule(n, a, b, seed, epochs, negatives)
    place = rule.place(F.col("slot"))
    block = lambda slot: (slot % rule.blocks).cast("int").alias("block")
    ours = points.select(block(F.col("slot")), place.alias("place"), "key", "x", "y")
    theirs = edges.select(block(F.col("src")), F.floor(F.col("src") / rule.blocks).cast("int").alias("head"), rule.place(F.col("dst")).alias("tail"), "w")
    packed = ours.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(_pack, f"{HELD}, x array<double>, y array<double>")
    packed = materialise(packed, "blocks")
    dealt = lambda df: df.repartitionById(max(2, rule.blocks), "block")  # noqa: E731 - a single partition would be dealt out again
    held = dealt(packed.drop("x", "y")).persist()
    sent, stored = packed.mapInArrow(partial(_begin, rule=rule), SENT), None
    for epoch in range(-1, epochs):
        sent = held.groupBy("block").cogroup(dealt(sent).groupBy("block")).applyInArrow(partial(_step, rule=rule, epoch=epoch), SENT)
        if (epoch + 1) % EPOCHS == 0 or epoch == epochs - 1:
            sent, before = materialise(sent, "layout"), stored
            release(before)
            stored = sent
    held.unpersist()
    one = sent.select("block", F.posexplode(F.arrays_zip("x", "y")).alias("k", "at"))
    return one.select((F.col("k").cast("long") * rule.blocks + F.col("block")).alias("slot"), "at.x", "at.y")
