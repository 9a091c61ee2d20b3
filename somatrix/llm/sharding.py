"""Uniform shuffling into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each partition a uniform shuffle would send to each shard follows a multivariate hypergeometric
distribution, given both's sizes. That matrix is drawn by halves: how a group of partitions divides each shard with the
group after it, then the same inside both. The driver draws it for large groups of partitions; tasks draw each group's
lines. Each partition permutes its rows and deals them out by its line; each shard permutes what it gets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somatrix.tables import free_names, materialise, table

#: Rows of a shard that one task orders, about; and partitions whose lines one task draws.
BLOCK, GROUP = 100_000, 1024


def log_falling(a: int, d: int) -> float:
    """The logarithm of a! / (a - d)!, for 0 <= a and 0 <= a - d, accurate also where both factorials are huge."""
    if d < 0:
        return -log_falling(a - d, -d)
    if d == 0:
        return 0.0
    if a < 1000 or a - d < 100:
        return math.lgamma(a + 1) - math.lgamma(a - d + 1)
    b = a - d  # Stirling's series, written by differences
    tail = (1 / a - 1 / b) / 12 - (1 / a**3 - 1 / b**3) / 360 + (1 / a**5 - 1 / b**5) / 1260
    return d * math.log(a) - (b + 0.5) * math.log1p(-d / a) - d + tail


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, for numbers of any size: by ratio of uniforms, rejecting
    against the exact probabilities (Stadlober 1990)."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    share = good / total
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    width = math.sqrt(n * share * (1 - share) * (total - n) / max(total - 1, 1) + 0.5)
    scale, centre = width * 2 * math.sqrt(2 / math.e) + 3 - 2 * math.sqrt(3 / math.e), n * share + 0.5
    while True:
        u = rng.random()
        x = math.floor(centre + scale * (rng.random() - 0.5) / u) if u else low - 1
        if low <= x <= high:
            d = x - mode
            # of P(x) / P(mode), where P(x) is in proportion to 1 / (x! (good - x)! (n - x)! (bad - n + x)!)
            ratio = log_falling(good - mode, d) + log_falling(n - mode, d) - log_falling(x, d) - log_falling(bad - n + x, d)
            if 2 * math.log(u) <= ratio:
                return x


def communication_matrix(partitions: list[int], shards: list[int], seed: int | list[int]) -> np.ndarray:
    """Counts (partition, shard) as a uniformly random deal gives them; lines and columns sum to the sizes."""
    rng = np.random.default_rng(seed)
    sums = [0, *np.cumsum(np.array(partitions, object))] if partitions else [0]
    out = np.zeros((len(partitions), len(shards)), np.int64)
    todo = [(0, len(partitions), list(shards))] if partitions else []
    while todo:
        a, b, room = todo.pop()
        if b - a == 1:
            out[a] = room
            continue
        middle = (a + b) // 2
        rest, among, left = int(sums[middle] - sums[a]), int(sums[b] - sums[a]), []
        for places in room:
            among -= places
            left.append(hypergeometric(rng, places, among, rest))
            rest -= left[-1]
        todo += [(middle, b, [x - y for x, y in zip(room, left, strict=True)]), (a, middle, left)]
    return out


def matrix_lines(sizes: DataFrame, shards: list[int], seed: int, group: int = GROUP) -> DataFrame:
    """(part, ends): each partition's line of the matrix, as running sums; ``sizes`` is (part, n), part from 0. The driver
    sees one number for each ``group`` of partitions."""
    spark = sizes.sparkSession
    grouped = sizes.withColumn("group", F.floor(F.col("part") / group).cast("long"))
    sums = grouped.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect()
    lines = communication_matrix([r["n"] for r in sums], shards, [seed, 0]).tolist()
    room = spark.createDataFrame([(r["group"], x) for r, x in zip(sums, lines, strict=True)], "group long, room array<long>")

    def draw(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        matrix = communication_matrix(frame["n"].tolist(), frame["room"].iloc[0].tolist(), [seed, 1, int(key[0])])
        return pd.DataFrame({"part": frame["part"], "ends": np.cumsum(matrix, axis=1).tolist()})

    return grouped.join(room, "group").groupBy("group").applyInPandas(draw, "part long, ends array<long>")


def shard_rows(docs: DataFrame, columns: list[Column], shards: int = 24, seed: int = 5) -> DataFrame:
    """The given ``columns`` of every row of ``docs``, with ``shard`` (0 to shards - 1) and ``slot``, the row's place in
    its shard, gapless from 0. Shards' sizes differ by one at most, the larger ones first; every deal of the rows is
    equally likely over the seed.

    The columns are written to the shared folder once, with each row's partition and place, so that all later steps see
    the same partitions, also after an executor was lost. Nulls, empty and very long texts, ties and repeated rows make
    no difference, since a row's place decides. An empty table gives no rows. Columns may have any names but ``shard``
    and ``slot``. A shard is ordered in blocks of about ``BLOCK`` rows.
    """
    number = F.monotonically_increasing_id()
    plain = docs.select(*columns)
    part, row, order, block, place, before, ends = free_names(plain, "part", "row", "order", "block", "place", "before", "ends")
    placed = materialise(plain.select("*", F.shiftright(number, 33).alias(part), number.alias(row)), "placed")
    sizes = materialise(placed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")), "part_sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    even = [total // shards + (s < total % shards) for s in range(shards)]
    lines = materialise(matrix_lines(sizes, even, seed).withColumnsRenamed({"part": part, "ends": ends}), "matrix")

    local = Window.partitionBy(part).orderBy(F.xxhash64(row, F.lit(seed)), row)
    ranked = placed.withColumn(place, F.row_number().over(local) - 1).join(lines, part)
    shard = F.size(F.filter(ends, lambda x: x <= F.col(place))).cast("int")
    dealt = ranked.withColumn("shard", shard).drop(ends, place, part)

    blocks = max(1, -(-total // (shards * BLOCK)))
    shuffled = F.xxhash64(row, F.lit(seed + 1))
    within_shard = F.floor((F.shiftright(F.col(order), 33) + (1 << 30)) * blocks / (1 << 31)).cast("long")
    dealt = materialise(dealt.withColumn(order, shuffled).withColumn(block, within_shard), "dealt")
    counts = dealt.groupBy("shard", block).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("shard", block).orderBy(order, row)
    slotted = dealt.withColumn(place, F.row_number().over(within) - 1).join(offsets, ["shard", block])
    return slotted.withColumn("slot", (F.col(place) + F.col(before)).cast("long")).select(*plain.columns, "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    columns = [F.col("doc_id"), (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return shard_rows(docs, columns).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
