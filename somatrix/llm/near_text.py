"""Real similarity for the SimHash operator: the Jaccard similarity of sets of five-word shingles, 0.8 or more.

Fingerprints alone miss most edited copies at that similarity. An exact cover, prefix filtering, lists the rest: in any
order of all shingles, two sets of similarity s share one of their first n - ceil(s n) + 1. The order here puts shingles
that a sample has often last, so that common passages are in few prefixes; the sample changes the work, never the
result. Candidates are compared by sketches first: a bit a class of hashes, set where a set has an odd number of them.
Each shingle that only one of two sets has changes one bit, so sketches differ in no more bits than there are such shingles;
for similar sets of m and n these are (m + n) / 9 at most. What passes is compared by whole sets.

A list of one shingle's documents isn't listed pair by pair. In each round a few of its documents, drawn by a hash, are
compared with all others of it that aren't joined to them yet, as long as a round halves the pairs that are left apart.
Of a list that keeps many of them, the sketches are then compared in blocks of documents against blocks, inside tasks,
which give the pairs that sketches allow and no others: first only a forest of these, fewer than documents, so that a group
of near copies is joined without all its pairs, then what nothing joins yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.llm.common import small
from somatrix.operators.graph import components
from somatrix.tables import materialise, release

WIDTH = 5
#: The least similarity, as a fraction, so that all comparisons are of integers.
OVER, UNDER = 4, 5
#: Documents, about, whose shingles are counted for the order; how many make one common; and the most that are remembered.
ORDER_DOCUMENTS, COMMON, MOST_COMMON = 50_000, 3, 200_000
#: Documents of a list that a round compares with the others; how many pairs left apart, for each of its rows, a list may
#: have that are listed; and documents of a block, whose sketches take 512 KB, and longer texts' fine ones an eighth of a byte
#: a shingle more.
HUBS, APART, BLOCK = 2, 8, 4096
#: Passes in which blocks give a forest of the pairs that sketches allow, before all that are left are given.
FORESTS = 2
#: 64-bit numbers of a sketch. Sets of more shingles than it has bits have a fine one as well.
SKETCH = 16
MIX = np.random.default_rng(5).integers(0, 2**63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct word shingles as 64-bit hashes, ascending; a text of fewer words has one, its whole word sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    width = min(width, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed += hashes[k : k + n] * MIX[k]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[WIDTH]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def row_key(*parts) -> Column:
    return F.xxhash64(*parts)


def with_keys(docs: DataFrame, mark: str, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with a 64-bit key in ``mark``, equal for rows of equal id and text alone; and whether any key repeats.

    Where rows of one key differ, by SHA-256 of their text or by id, they get other keys, until none do.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    whole = F.concat_ws(" ", F.col(id_col).isNull().cast("string"), F.col(id_col).cast("string"), F.col(text_col).isNull().cast("string"), digest)
    keyed, turn = docs.withColumn(mark, row_key(id_col, text_col)), 0
    while True:
        seen = keyed.groupBy(mark).agg(F.count("*").alias("times"), F.min(whole).alias("one"), F.max(whole).alias("other")).filter("times > 1")
        seen = materialise(seen.select(mark, (F.col("one") != F.col("other")).alias("clash")), "near_keys")
        clashes = seen.filter("clash")
        if clashes.isEmpty():
            return keyed, not seen.isEmpty()
        turn += 1
        joined = keyed.join(clashes, mark, "left")
        other = F.when(F.col("clash"), row_key(F.col(mark), F.lit(turn), whole)).otherwise(F.col(mark))
        keyed = joined.withColumn(mark, other).select(*docs.columns, mark)


def shingle_sets(slim: DataFrame) -> DataFrame:
    """(key, n, shingles) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(x.as_py()).view(np.int64) for x in batch.column("text")]
            lists = pa.array(sets, pa.list_(pa.int64()))
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), sizes, lists], ["key", "n", "shingles"])

    return slim.select("key", "text").mapInArrow(run, "key long, n long, shingles array<long>")


def parities(shingles: np.ndarray, longs: int) -> np.ndarray:
    """A bit for each class of hashes, set where the set has an odd number of them."""
    odd = np.bincount((shingles % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def fine_size(n: int) -> int:
    """64-bit numbers of a fine sketch: bits for every shingle, to the next power of two; 0 where the usual one has as many."""
    longs = SKETCH
    while 64 * longs < n:
        longs *= 2
    return longs if longs > SKETCH else 0


def sketches(slim: DataFrame) -> DataFrame:
    """(key, n, sketch, fine) of rows (key, text): the size of the shingle set, and its parities as arrays of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, fine, sizes = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                longs = fine_size(len(s))
                found.append(parities(s, SKETCH))
                fine.append(parities(s, longs) if longs else np.empty(0, np.int64))
                sizes.append(len(s))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, fine)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), *lists], ["key", "n", "sketch", "fine"])

    return slim.select("key", "text").mapInArrow(run, "key long, n long, sketch array<long>, fine array<long>")


def _common(slim: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and in how many of its documents each is."""
    draw = F.pmod(F.xxhash64("key", F.lit("order")), F.lit(1 << 30)) / float(1 << 30)
    drawn = shingle_sets(slim.filter(draw < ORDER_DOCUMENTS / max(slim.count(), 1))).select(F.explode("shingles").alias("s"))
    counts = drawn.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toPandas()
    names = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], rows["n"].to_numpy(np.int64)[order]


def prefixes(slim: DataFrame) -> DataFrame:
    """(s, key, n, at): the shingles of each document's prefix, with the set's size and their places in the order."""
    shared = slim.sparkSession.sparkContext.broadcast(_common(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = shared.value
        for batch in small(batches):
            found, sizes = [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                rank = np.zeros(len(s), np.int64)
                if len(names):
                    place = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    rank = np.where(names[place] == s, counts[place], 0)
                found.append(s[np.argsort(rank, kind="stable")][: len(s) + 1 + -OVER * len(s) // UNDER])
                sizes.append(len(s))
            lengths = [len(x) for x in found]
            columns = [
                np.concatenate(found).view(np.int64),
                np.repeat(np.asarray(batch.column("key")), lengths),
                np.repeat(sizes, lengths),
                np.concatenate([np.arange(x) for x in lengths]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["s", "key", "n", "at"])

    return slim.select("key", "text").mapInArrow(run, "s long, key long, n long, at long")


def prefix_lists(slim: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose shingle two or more rows have."""
    times = F.count("*").over(Window.partitionBy("s"))
    return materialise(prefixes(slim).withColumn("times", times).filter("times > 1").drop("times"), "near_lists")


def _sketches_allow(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b), each once, that neither sizes nor sketches rule out."""
    left = sketched.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("left"))
    right = sketched.select(F.col("key").alias("b"), "n", F.col("sketch").alias("right"))
    differ = sum((F.bit_count(F.col("left")[i].bitwiseXOR(F.col("right")[i])) for i in range(SKETCH)), F.lit(0))
    may = (UNDER * F.least("m", "n") >= OVER * F.greatest("m", "n")) & ((OVER + UNDER) * differ <= F.col("m") + F.col("n"))
    return pairs.distinct().join(left, "a").join(right, "b").filter(may).select("a", "b")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, left, right) whose texts' whole sets are similar; b's rows come together."""
    last, right = None, np.zeros(0, np.uint64)
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        b = np.asarray(batch.column("b"))
        for i in range(batch.num_rows):
            if b[i] != last:
                last, right = b[i], shingle_set(batch.column("right")[i].as_py())
            left = shingle_set(batch.column("left")[i].as_py())
            both = len(np.intersect1d(left, right, assume_unique=True))
            near[i] = UNDER * both >= OVER * (len(left) + len(right) - both)
        yield batch.select(["a", "b"]).filter(pa.array(near))


def similar(pairs: DataFrame, texts: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar; ``texts`` is (key, text), each key once, and ``sketched``
    their ``sketches``. Texts travel, not their sets: hashes don't compress."""
    pairs = materialise(_sketches_allow(pairs, sketched), "near_pairs")
    asked = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    read = materialise(texts.join(asked, "key", "left_semi"), "near_asked")
    left = read.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = read.select(F.col("key").alias("b"), F.col("text").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    links = materialise(met.mapInArrow(_compared, "a long, b long"), "near_links")
    release(read)
    release(pairs)
    return links


def _could_be_similar() -> Column:
    """What two sets can share from here on, were this shingle the first that they share, has to suffice."""
    left = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    return (OVER + UNDER) * left >= OVER * (F.col("n") + F.col("n_2"))


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    return lists.join(roots, lists["key"] == roots["node"], "left").select("s", "key", "n", "at", F.coalesce("root", "key").alias("root"))


def _hub_pairs(rooted: DataFrame, turn: int) -> DataFrame:
    """(a, b): each list's drawn documents with all others of the list that they aren't joined to."""
    whole = F.struct(F.col("key").alias("key_2"), F.col("n").alias("n_2"), F.col("at").alias("at_2"), F.col("root").alias("root_2"))
    drawn = [F.min_by(whole, F.xxhash64("key", F.lit(turn * HUBS + j))) for j in range(HUBS)]
    hubs = rooted.groupBy("s").agg(F.array_distinct(F.array(*drawn)).alias("hubs")).select("s", F.inline("hubs"))
    met = rooted.join(hubs, "s").filter("root <> root_2").filter(_could_be_similar())
    return met.select(F.least("key", "key_2").alias("a"), F.greatest("key", "key_2").alias("b"))


def _pairs_apart(rooted: DataFrame) -> DataFrame:
    other = rooted.select("s", *(F.col(c).alias(f"{c}_2") for c in ("key", "n", "at", "root")))
    met = rooted.join(other, "s").filter("key < key_2 and root <> root_2").filter(_could_be_similar())
    return met.select(F.col("key").alias("a"), F.col("key_2").alias("b"))


def _apart(rooted: DataFrame) -> DataFrame:
    """(s, apart, k): the pairs of a list's documents that nothing joins yet, and the list's rows."""
    each = rooted.groupBy("s", "root").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    return each.groupBy("s").agg(((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("apart"), F.sum("n").alias("k"))


def _fine_differ(one: np.ndarray, other: np.ndarray) -> int:
    """In how many bits two fine sketches differ, the longer one folded to the length of the shorter one."""
    while len(one) > len(other):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while len(other) > len(one):
        other = other[: len(other) // 2] ^ other[len(other) // 2 :]
    return int(np.bitwise_count((one ^ other).view(np.uint64)).sum(dtype=np.int64))  # of signed numbers it counts the absolute value's


def _near_by_sketch(group: pa.Table, forest: bool) -> pa.Table:
    """Pairs of a block's documents with another's, or with each other, that aren't joined and that sketches allow; as a
    ``forest`` only those that join what those before leave apart."""
    key, n, root, block = (group[c].to_numpy() for c in ("key", "n", "root", "block"))
    sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), SKETCH)
    fine = group["fine"].combine_chunks()
    bits, starts = fine.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(fine.value_lengths().to_numpy())]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while x in top:
            if top[x] in top:
                top[x] = top[top[x]]
            x = top[x]
        return x

    one = np.flatnonzero(block == group["low"][0].as_py())
    two = np.flatnonzero(block == group["high"][0].as_py())
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in one:
        differ = np.bitwise_count(sketch[two] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        may = (root[two] != root[i]) & (UNDER * np.minimum(n[two], n[i]) >= OVER * np.maximum(n[two], n[i]))
        near = two[may & ((OVER + UNDER) * differ <= n[two] + n[i])]
        kept = np.ones(len(near), bool)
        own = bits[starts[i] : starts[i + 1]]
        for at, j in enumerate(near.tolist()):
            x, y = (find(int(root[i])), find(int(root[j]))) if forest else (0, 1)
            other = bits[starts[j] : starts[j + 1]]
            kept[at] = x != y and (not len(own) or not len(other) or (OVER + UNDER) * _fine_differ(own, other) <= n[i] + n[j])
            if forest and kept[at]:
                top[x] = y
        near = key[near[kept]]
        a.append(np.minimum(near, key[i]))
        b.append(np.maximum(near, key[i]))
    found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pa.table({"a": found[0], "b": found[1]})


def pairs_left(rooted: DataFrame, sketched: DataFrame, forest: bool = False) -> DataFrame | None:
    """(a, b): pairs of documents of one list (s, key, n, at, root) that nothing joins yet, all that can be similar.

    Lists with few such pairs are joined with themselves. Of the others each document's sketches go to as many tasks as
    the list has blocks, to be compared there: the work is the square of a list's documents, the rows are so over
    ``BLOCK``, and what comes out are near pairs. As a ``forest`` they are fewer than a task's documents, and lists with
    few pairs give none (no table where all lists are such). A list of one block isn't dealt out: its rows go to one task each once.
    """
    counts = materialise(_apart(rooted).filter("apart > 0"), "near_apart")
    few = counts.filter(F.col("apart") <= APART * F.col("k")).select("s")
    many = counts.filter(F.col("apart") > APART * F.col("k")).select("s", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    most = many.agg(F.max("blocks")).first()[0] or 0
    if not most:
        return _pairs_apart(rooted.join(few, "s", "left_semi")) if not forest else None
    large = rooted.select("s", "key", "root").join(many, "s").join(sketched, "key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if most > 1 else F.lit(0)
    large = large.withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).withColumn("other", other)
    large = large.select("s", "key", "n", "root", "block", "sketch", "fine", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    near = large.groupBy("s", "low", "high").applyInArrow(lambda group: _near_by_sketch(group, forest), "a long, b long")
    return near if forest else _pairs_apart(rooted.join(few, "s", "left_semi")).unionByName(near)


def similar_groups(lists: DataFrame, texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, root): the groups that links of similarity 0.8 or more join, among all pairs. ``candidates`` (a, b) are
    compared in the first round."""
    sketched = materialise(sketches(texts), "near_sketches")
    before, turn, rooted = None, 0, lists.withColumn("root", F.col("key"))
    links = None
    while True:
        pairs = _hub_pairs(rooted, turn)
        found = similar(pairs.unionByName(candidates) if turn == 0 else pairs, texts, sketched)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        if turn:
            release(rooted)
        rooted = materialise(_rooted(lists, roots), "near_rooted")
        apart = _apart(rooted).agg(F.sum("apart")).first()[0] or 0.0
        if before is not None and 2 * apart > before or apart <= APART * lists.count():
            break
        before, turn = apart, turn + 1
    if not apart:
        return roots
    for _ in range(FORESTS):
        pairs = pairs_left(rooted, sketched, forest=True)
        if pairs is None:
            break
        links = links.unionByName(similar(pairs, texts, sketched))
        earlier, rooted = rooted, materialise(_rooted(lists, components(links)), "near_rooted")
        release(earlier)
    return components(links.unionByName(similar(pairs_left(rooted, sketched), texts, sketched)))
