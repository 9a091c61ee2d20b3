"""SimHash near-duplicates, with pivot distance tables.

Candidates come from an exact cover: the 64 bits are four blocks, and fingerprints that differ in two bits or fewer
agree on two whole blocks at least, so each fingerprint goes to the six buckets of its block pairs. A bucket with many
members is split again by the bits that its members don't share yet, twice at most, after which at most 2**14
fingerprints can share a bucket. Inside a bucket the pivot table does the pruning: by the triangle inequality, two
fingerprints at distance 2 or less have distances to any reference fingerprint that differ by 2 or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm import near_text
from somatrix.llm.common import small
from somatrix.operators.graph import components
from somatrix.tables import free_names, materialise, release, table

#: Reference fingerprints of the pivot table: drawn once from this seed.
PIVOT_SEED, N_PIVOTS = 20, 24
#: Two blocks of 16 bits out of four. A bucket whose fingerprints share one of these masks has 32 bits left to differ in.
BLOCKS = [((1 << 16) - 1) << (16 * i) for i in range(4)]
MASKS = [BLOCKS[i] | BLOCKS[j] for i in range(4) for j in range(i + 1, 4)]


def pivots() -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)


def thirds(mask: int) -> list[int]:
    """The masks that share ``mask`` and a third of the other bits: with two differing bits, one third is equal."""
    rest = [1 << i for i in range(64) if not mask >> i & 1]
    cut = [round(len(rest) * k / 3) for k in range(4)]
    return [mask | sum(rest[cut[k] : cut[k + 1]]) for k in range(3)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles; 0 where it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): one row for each of ``docs``, fp the fingerprint's 64 bits as a signed long."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    return slim.mapInArrow(run, f"id {kind}, fp long")


def bucket_links(fps: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of a bucket at distance ``most`` or less, enough to join each of its components.

    ``bucket`` numbers the buckets, ascending. The pivot table orders each bucket by its first column; row i meets
    row i + s while that column differs by ``most`` or less, then the other columns have their say, then the bits.
    """
    reach = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((reach[:, 0], bucket))
    fps, bucket, reach = fps[order], bucket[order], reach[order]
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right, at, step = [], [], np.arange(len(fps)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fps)]
        at = at[(bucket[at + step] == bucket[at]) & (reach[at + step, 0] - reach[at, 0] <= most)]
        near = at[(np.abs(reach[at + step] - reach[at]) <= most).all(axis=1)]
        near = near[np.bitwise_count(fps[near + step] ^ fps[near]) <= most]
        for i in near[root[near] != root[near + step]]:
            a, b = find(i), find(i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        if step % 64 == 0:
            root = root[root]
    return fps[left], fps[right]


def _buckets(members: DataFrame) -> DataFrame:
    """Of rows (mask, fp), those whose bucket has two or more, with their number n."""
    keyed = members.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(sizes, ["mask", "value"])


def fingerprint_links(distinct: DataFrame, most: int = 2, split_above: int = 1024) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that join those at distance ``most`` (2 or
    less) as all such pairs would. A bucket of m members gives m - 1 links at most."""
    if most > 2:
        raise ValueError("the cover holds for distances of 2 or less")
    spark = distinct.sparkSession
    ready, masks = [], MASKS
    members = distinct.select(F.explode(F.array(*[F.lit(signed(m)) for m in MASKS])).alias("mask"), "fp")
    for level in range(3):
        found = materialise(_buckets(members), "buckets")
        if level == 2:
            ready.append(found)
            break
        ready.append(found.filter(F.col("n") <= split_above))
        large = found.filter(F.col("n") > split_above)
        if large.isEmpty():
            break
        finer = [(m, sub) for m in masks for sub in thirds(m)]
        pairs = spark.createDataFrame([(signed(m), signed(s)) for m, s in finer], "mask long, sub long")
        members = large.join(F.broadcast(pairs), "mask").select(F.col("sub").alias("mask"), "fp").distinct()
        masks = [s for _, s in finer]
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)
        for batch in batches:
            rest = np.vstack([rest, np.column_stack([np.asarray(batch.column(c)) for c in ("mask", "value", "fp")])])
            change = np.flatnonzero((rest[1:, :2] != rest[:-1, :2]).any(axis=1)) + 1
            if not len(change):
                continue
            done, rest = rest[: change[-1]], rest[change[-1] :]
            yield links(done)
        if len(rest):
            yield links(rest)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[0, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        a, b = bucket_links(rows[:, 2].view(np.uint64), np.cumsum(new), most)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = whole.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """For every row of ``docs``: its id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest
    id of the documents that links of ``most`` or fewer differing bits reach from it, itself included.

    Null, empty and wordless texts have fingerprint zero and link like any other; a text of fewer words than a shingle
    has its whole word sequence as its only one. Rows of equal fingerprint are one node, so copies are never paired.
    Null ids are no component's smallest unless all its ids are null. An empty table gives no rows; repeated rows
    each get their row; further columns are ignored, whatever their names.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(nodes.select("fp"), most))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _candidates(slim: DataFrame) -> DataFrame:
    """(a, b): keys of ``slim`` (key, id, text) to compare, of fingerprints over five-word shingles that are 2 bits or
    less apart: of each link between fingerprints, and of each fingerprint's documents, the least key stands for it."""
    marked = materialise(fingerprints(slim, "key", "text", near_text.WIDTH).withColumnRenamed("id", "key"), "near_fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("key").alias("least")), "near_nodes")
    links = fingerprint_links(nodes.select("fp"))
    for end in ("a", "b"):
        links = links.join(nodes.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_key")), end)
    copies = marked.join(nodes, "fp").filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    return links.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).unionByName(copies)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; all columns stay as they are.

    Near duplicates are documents whose sets of five-word shingles have a similarity of 0.8 or more; a group is what such
    links join. Fingerprints that the pivot tables find within 2 bits are compared first, whole set by whole set; an exact
    cover (``near_text``) then lists what fingerprints miss.

    Words are separated by white space, A-Z lower-cased. Null, empty and wordless texts are copies of each other; a text
    of fewer than five words is similar to those of its word sequence alone; very long texts are compared whole. Null ids
    are no group's smallest unless all are null. Of rows that repeat id and text one stays; rows that repeat an id with
    other texts are different documents, of which each group keeps its own. An empty table gives no rows; further columns
    may have any names.
    """
    mark = free_names(docs, "near_key")[0]
    keyed, repeated = near_text.with_keys(docs, mark, id_col, text_col)
    slim = keyed.select(F.col(mark).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = slim.select("key", "text")
    if repeated:
        texts = materialise(texts.dropDuplicates(["key"]), "near_texts")
    lists = near_text.prefix_lists(texts)
    roots = near_text.similar_groups(lists, texts, _candidates(texts))
    release(lists)
    named = materialise(slim.select("key", "id").join(roots, slim["key"] == roots["node"]).select("root", "key", "id"), "near_named")
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("kept"))
    gone = materialise(named.join(kept, "root").filter("key <> kept").select(F.col("key").alias(mark)).distinct(), "near_gone")
    left = keyed.join(gone, mark, "left_anti")
    return (left.dropDuplicates([mark]) if repeated else left).select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
