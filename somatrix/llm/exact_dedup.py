"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm.common import ascii_lower, join_groups
from somatrix.tables import free_names, materialise, table


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    return rows.withColumn("digest", F.sha2("content", 256))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size) of rows (id, content, digest): combined inside tasks, by salt, and whole."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("digest", "content", "salt").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return by_salt.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """For every row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.
    Equal texts are first combined inside each task, then by (digest, salt), then the salt winners by digest.
    Each of these groupings has the whole text as a key besides its digest, so content is compared, not trusted to a
    hash, and a group's rows spread over ``salts`` tasks whatever its size. Once every digest is known to stand for
    one content, rows find their group by digest, those of large groups through a broadcast of these groups, fewer than a
    thousand; digests that stand for several contents are joined by content too.

    Null text counts as empty. A null id never stays unless its whole group has null ids. Repeated rows (same id and
    text) each get their row; ``kept`` is true for all that carry the kept id. An empty table gives no rows. Further
    columns are ignored, whatever their names. Very long texts are compared whole.
    """
    rows = _rows(docs, id_col, text_col)
    groups = _combined(rows, salts)
    slim = materialise(
        groups.select("digest", F.xxhash64("content").alias("mark"), F.length("content").alias("chars"), "keep_id", "group_size"),
        "exact_groups",
    )
    shared = slim.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    if shared.isEmpty():
        total = slim.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        own = F.concat(F.lit("-"), F.xxhash64("id").cast("string"))
        joined = join_groups(rows.drop("content"), slim.drop("mark", "chars"), "digest", "group_size", total, own)
    else:  # one digest, several contents
        joined = rows.join(groups, ["digest", "content"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` without the rows whose text another row of larger id has; all columns stay as they are.

    One row stays of rows that repeat id and text. Nulls, empty tables and very long texts as in ``exact_groups``; further
    columns may have any names.
    """
    keep_id, digest = free_names(docs, "keep_id", "digest")
    kept = materialise(_combined(_rows(docs, id_col, text_col), salts).select(F.col("keep_id").alias(keep_id), F.col("digest").alias(digest)), "exact_kept")
    marked = docs.withColumn(digest, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    here = marked[id_col].eqNullSafe(kept[keep_id]) & (marked[digest] == kept[digest])
    found = marked.join(kept, here, "left_semi")
    if not docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        found = found.dropDuplicates([id_col, digest])
    return found.select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
