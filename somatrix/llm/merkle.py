"""Merkle manifest of a dataset: ranks from digit histograms key the nodes of a trie, which is reduced prefix by prefix."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from somatrix.llm.ranks import group_key, ranked
from somatrix.tables import materialise, table

#: Most nodes of a trie that one task reduces together.
REDUCED = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256, as lowercase hex, of each value's bytes in UTF-8 behind their number and a colon; a null is a hyphen."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _height(nodes: int, fanout: int) -> int:
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def _reduced(nodes: list[str], fanout: int, levels: int) -> tuple[str, list[list[str]]]:
    """The node that ``levels`` rounds of hashing runs leave, and each node's path: for each round the digests of its run,
    an asterisk in its own place."""
    above: list[list[str]] = []
    while len(above) < levels:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        above.append(["".join([*run[:p], "*", *run[p + 1 :]]) for run in runs for p in range(len(run))])
        nodes = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
    return nodes[0], above


def _round(nodes: DataFrame, fanout: int) -> tuple[DataFrame, int]:
    """``nodes`` (trie, rank, digest, total and more) with ``parent``, the node of the next round (rank without its last
    digits), ``parent_digest`` and ``path``; and how many nodes a parent has. Nodes of one parent, at most ``REDUCED``,
    are one group."""
    span, levels = fanout, 1
    while span * fanout <= REDUCED:
        span, levels = span * fanout, levels + 1

    def reduce(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        here = min(levels, _height(group["total"][0].as_py(), fanout))
        digest, above = _reduced(group["digest"].to_pylist(), fanout, here)
        path = [[level[i // fanout**k] for k, level in enumerate(above)] for i in range(group.num_rows)]
        out = group.append_column("parent_digest", pa.array([digest] * group.num_rows, pa.string()))
        return out.append_column("path", pa.array(path, pa.list_(pa.string())))

    keyed = nodes.withColumn("parent", F.expr(f"rank div {span}L"))
    schema = StructType([*keyed.schema, StructField("parent_digest", StringType()), StructField("path", ArrayType(StringType()))])
    return keyed.groupBy("trie", "parent").applyInArrow(reduce, schema), span


def tries(nodes: DataFrame, fanout: int = 2) -> DataFrame:
    """``nodes`` (trie, rank, digest, total and more) with ``path`` and ``subroot``: in each trie every ``fanout``
    successive nodes, the last run fewer, become the digest of their digests until one is left, the subroot; a lone node
    is one.

    ``path`` lists a node's runs level by level, an asterisk where the node's own digest goes. Tasks reduce the nodes
    that share their rank but for the last digits, at most 4,096; what that leaves is reduced again. No rows give none.
    """
    rounds, level = [], nodes
    while True:
        reduced, span = _round(level, fanout)
        reduced = materialise(reduced, "trie_round")
        rounds.append(reduced)
        if reduced.filter(F.col("total") > span).isEmpty():
            break
        level = reduced.groupBy("trie", F.col("parent").alias("rank")).agg(
            F.min("parent_digest").alias("digest"), F.expr(f"(min(total) + {span - 1}L) div {span}L").alias("total")
        )
    out = rounds.pop().withColumnRenamed("parent_digest", "subroot").drop("parent")
    while rounds:  # a node's path goes on with its parent's
        above = out.select("trie", F.col("rank").alias("parent"), F.col("path").alias("further"), "subroot")
        joined = rounds.pop().drop("parent_digest").join(above, ["trie", "parent"])
        out = joined.withColumn("path", F.concat("path", "further")).drop("parent", "further")
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a digest and its path give."""
    return F.aggregate(path, leaf, lambda own, run: F.sha2(F.replace(run, F.lit("*"), own), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all the siblings on a path."""
    return F.sha2(F.replace(F.array_join(path, ""), F.lit("*"), F.lit("")), 256)


def manifest(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """``rows`` (id, part, leaf, presented) become (id, part, leaf, presented, path, subroot, root): each part's leaves
    form a trie by ascending id, the parts' subroots another one in order of the parts' bytes. ``path`` leads from a leaf
    to the root; ``folded(presented, path)`` is the root that a presented leaf proves.

    Leaves of one id are ordered by leaf, equal ones anyhow; a null id comes before others, a null part before others.
    Repeated rows are leaves of their own. A lone leaf is its part's subroot, a lone part's subroot the root. No rows give
    no rows. Any number of rows may share an id, or a part.
    """
    keyed = rows.select("id", "part", "leaf", "presented", group_key(F.col("part")).alias("trie"))
    leaves = tries(ranked(keyed, "trie", "id", "leaf").withColumn("digest", F.col("leaf")), fanout)
    subroots = leaves.filter("rank = 0").select(F.col("trie").alias("of"), F.col("subroot").alias("digest"))
    name = F.hex(F.encode(F.substring("of", 2, (1 << 31) - 1), "UTF-8"))
    first = F.when(F.col("of") != "", F.conv(F.rpad(F.substring(name, 1, 14), 14, "0"), 16, 10).cast("long"))  # seven bytes
    subroots = ranked(subroots.withColumns({"trie": F.lit("parts"), "first": first, "name": name}), "trie", "first", "name")
    high = tries(subroots, fanout).select(F.col("of").alias("trie"), F.col("path").alias("further"), F.col("subroot").alias("root"))
    found = leaves.join(high, "trie").withColumn("path", F.concat("path", "further"))
    return found.select("id", "part", "leaf", "presented", "path", "subroot", "root")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of its language's trie, its proof, and whether it still proves the root after every
    document whose crc32 of the id is a multiple of 7 had 1 added to n_chars. A null id isn't tampered with, nor a null
    n_chars. Ties, repeated rows and empty tables as in ``manifest``; further columns are ignored."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    longer = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    leaf = leaf_digest(*map(F.col, FIELDS))
    presented = F.when(tampered, leaf_digest(*[longer if c == "n_chars" else F.col(c) for c in FIELDS])).otherwise(leaf)
    found = manifest(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), leaf.alias("leaf"), presented.alias("presented")))
    found = found.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("presented"), F.col("path"))})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda z: CAST(z AS BIGINT))),
        lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))) AS crc
  FROM documents
), e AS (
  SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m_chars
  FROM d
), l AS (
  SELECT doc_id, lang, leaf, sha256(head || CASE WHEN m_chars IS NULL THEN '-' ELSE strlen(CAST(m_chars AS VARCHAR)) || ':' || m_chars END || tail) AS presented,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, row_number() OVER () AS id
  FROM e
), low(lang, level, k, digest, m) AS (
  SELECT lang, 0, r, leaf, count(*) OVER (PARTITION BY lang) FROM l
  UNION ALL
  SELECT lang, level + 1, k // 2, sha256(string_agg(digest, '' ORDER BY k)), (min(m) + 1) // 2 FROM low WHERE m > 1 GROUP BY lang, level, k // 2
), s AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS r FROM low WHERE m = 1
), high(level, k, digest, m) AS (
  SELECT 0, r, subroot, count(*) OVER () FROM s
  UNION ALL
  SELECT level + 1, k // 2, sha256(string_agg(digest, '' ORDER BY k)), (min(m) + 1) // 2 FROM high WHERE m > 1 GROUP BY level, k // 2
), t AS (SELECT digest AS root, level AS height FROM high WHERE m = 1),
steps AS (
  SELECT l.id, low.level AS step, CASE WHEN low.k % 2 = 1 THEN other.digest ELSE '' END AS before, CASE WHEN low.k % 2 = 0 THEN coalesce(other.digest, '') ELSE '' END AS after
  FROM l JOIN low ON low.lang IS NOT DISTINCT FROM l.lang AND low.k = l.r >> low.level AND low.m > 1
  LEFT JOIN low other ON other.lang IS NOT DISTINCT FROM low.lang AND other.level = low.level AND other.k = xor(low.k, 1)
  UNION ALL
  SELECT l.id, s.height + high.level, CASE WHEN high.k % 2 = 1 THEN other.digest ELSE '' END, CASE WHEN high.k % 2 = 0 THEN coalesce(other.digest, '') ELSE '' END
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN high ON high.k = s.r >> high.level AND high.m > 1
  LEFT JOIN high other ON other.level = high.level AND other.k = xor(high.k, 1)
), proofs AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, count(*) AS n FROM steps GROUP BY id),
fold(id, step, own) AS (
  SELECT id, 0, presented FROM l
  UNION ALL
  SELECT fold.id, fold.step + 1, sha256(before || own || after) FROM fold JOIN steps ON steps.id = fold.id AND steps.step = fold.step
)
SELECT l.doc_id, l.leaf, s.subroot, t.root, coalesce(proofs.proof, sha256('')) AS proof_sha256, fold.own AS folded_root, fold.own = t.root AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN t LEFT JOIN proofs ON proofs.id = l.id
JOIN fold ON fold.id = l.id AND fold.step = coalesce(proofs.n, 0)
"""
