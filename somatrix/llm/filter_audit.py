"""How filters interact: every order of the filters is replayed over every document's flags."""

from __future__ import annotations

import string
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.tables import materialise, table

SPACES = r"[\x20\x09-\x0D]+"
#: A group of equal texts with more than one row in so many is looked up in a broadcast of as many groups at most.
COMMON = 1000
#: Documents of one task of the replay, where there are enough for all cores.
REPLAYED = 200_000


def text_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, failed) for every row of ``docs``: an array of booleans, one for each of the filters A to E.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2 % of the code points are A-Z. D: one of
    ``#$%&*|``. E: a row of smaller id has the same text. Words lie between spaces and 0x09 to 0x0D, case-sensitive.

    Null text counts as empty, a null part as an empty string. A row of null id neither fails E nor makes others fail it;
    rows that share id and text don't fail because of each other. Texts are read whole; they are the same if their
    SHA-256 and length are. No rows give no rows; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    capitals = F.length("text") - F.length(F.translate("text", string.ascii_uppercase, ""))
    rows = rows.select(
        "id",
        "part",
        (F.size("words") < 200).alias("a"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("b"),
        (100 * capitals.cast("long") > 2 * F.length("text").cast("long")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d"),
        F.concat(F.sha2("text", 256), F.length("text").cast("string")).alias("same"),
    )
    rows = materialise(rows, "flags")
    groups = rows.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups, "same_texts")
    many = rows.count() // COMMON
    common = groups.filter(F.col("n") > many).select("same", F.col("first").alias("common"))  # under COMMON rows
    rare = groups.filter(F.col("n") <= many).select(F.col("same").alias("key"), "first")
    rows = rows.join(F.broadcast(common), "same", "left")
    own = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.col("part")))  # no group's key: the row is settled
    rows = rows.withColumn("key", F.when(F.col("common").isNull(), F.col("same")).otherwise(own)).join(rare, "key", "left")
    again = F.coalesce(F.col("id") > F.coalesce("common", "first"), F.lit(False))
    return rows.select("id", "part", F.array("a", "b", "c", "d", again).alias("failed"))


def with_labels(flagged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``flagged`` with ``good`` and ``toxic``: whether a row of ``labels`` for this id has quality 1, toxic 1. Ids
    without labels, null ids and null labels give false; labels that repeat an id count once."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    joined = flagged.join(known, "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def audit(flagged: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """For each value of ``part``, each order of ``filters`` and each step in it, what the step does.

    ``flagged`` has part, failed (one boolean a filter), good and toxic. Every row meets every order, a broadcast table of
    fixed size; its first failure in that order says at which step it goes; steps are exploded and their conditions
    summed, inside tasks first. Columns: part, filter_order, step, kept, removed, redundant (fails, but was gone),
    unique_fails (fails this filter only), good_lost, toxic_lost, shapley (removed by this filter, summed over all orders).

    Rows count one by one, repeated or not; a null part is a part. No rows give no rows. A part of any size is summed in
    as many tasks as have its rows.
    """
    spark, n = flagged.sparkSession, len(filters)
    orders = [("".join(filters[i] for i in p), [1 << i for i in p]) for p in permutations(range(n))]
    orders = spark.createDataFrame(orders, "filter_order string, bits array<int>")
    mask = sum((F.when(F.col("failed")[i], 1 << i).otherwise(0) for i in range(n)), F.lit(0))
    rows = materialise(flagged.select("part", mask.cast("int").alias("mask"), "good", "toxic"), "masks")
    tasks = max(spark.sparkContext.defaultParallelism, rows.count() // REPLAYED)
    met = rows.repartition(tasks).crossJoin(F.broadcast(orders))
    fails_at = lambda k: F.col("mask").bitwiseAND(F.col("bits")[k]) != 0
    first = F.coalesce(*[F.when(fails_at(k), k) for k in range(n)], F.lit(n))
    steps = met.select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    fails, removed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("at") == F.col("first")
    conditions = {
        "kept": F.col("first") > F.col("at"),
        "removed": removed,
        "redundant": fails & (F.col("first") < F.col("at")),
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = [F.count(F.when(condition, 1)).alias(name) for name, condition in conditions.items()]
    counted = materialise(steps.groupBy("part", "filter_order", "at", "bit").agg(*sums), "audit")
    shares = counted.groupBy(F.col("part").alias("of"), F.col("bit").alias("by")).agg(F.sum("removed").alias("shapley"))
    here = F.col("part").eqNullSafe(F.col("of")) & (F.col("bit") == F.col("by"))
    return counted.join(shares, here).select("part", "filter_order", (F.col("at") + 1).alias("step"), *conditions, "shapley")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` of the five text filters over all documents, by source."""
    flagged = with_labels(text_flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return audit(flagged)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), l AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)
), s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own FROM o, range(1, 6) r(step)),
k AS (SELECT part, failed, good, toxic, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL),
w AS (
  SELECT k.*, s.*, contains(failed, own) AS fails,
    coalesce((SELECT min(i) FROM range(1, 6) q(i) WHERE contains(failed, filter_order[i])), 6) AS first
  FROM k, s
), g AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN first > step THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN first = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails AND first < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN first = step THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN first = step THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM w GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
