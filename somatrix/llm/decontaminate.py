"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Terms are counted over the whole corpus first. A benchmark window with a term that no document has can't match; of each
other window, the rarest terms are indexed: postings (term, document, position). A window's posting lists are
intersected from the rarest on, each shifted by the term's offset in the item, so that a match is one equal (document,
diagonal); what survives all lists is compared word by word. A long list is dealt in parts of ``PART`` postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somatrix.llm.common import ascii_lower
from somatrix.tables import free_names, materialise, table

#: Everything below U+0080 but digits and a-z; A-Z is lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Postings, about, of each of the parts that a term's list is dealt in, by document.
PART = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, at, win): each run of ``width`` words of an item, from its word ``at``; all of a shorter item's words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0)))
    each = items.withColumn("at", F.explode(starts))
    return each.select("item", "at", F.slice("ws", F.col("at") + 1, F.lit(width)).alias("win")).distinct()


def window_terms(wins: DataFrame) -> DataFrame:
    """(item, at, win, term, offset): each distinct word of each window where it is first, offsets counted within the item."""
    each = wins.select("item", "at", "win", F.posexplode("win").alias("i", "term"))
    return each.groupBy("item", "at", "win", "term").agg((F.col("at") + F.min("i")).alias("offset"))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often each of ``terms`` (one column, ``term``) is in all of ``docs``, where it is.

    Words are counted inside tasks first, so that what is shuffled are a task's distinct words."""
    each = docs.select(F.explode(words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return materialise(each.join(terms.distinct(), "term", "left_semi"), "term_counts")


def row_mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, id, mark, pos, parts) of the words in ``terms`` (term, n); a list of n is to be dealt in ``parts``.

    id and mark, a hash of the text, tell rows apart that repeat an id.
    """
    entries = materialise(terms.select("term", F.ceil(F.col("n") / PART).cast("int").alias("parts")).distinct(), "index_terms")
    read = docs.select(F.col(id_col).alias("id"), row_mark(text_col).alias("mark"), words(F.col(text_col)).alias("ws"))
    each = read.select("id", "mark", F.posexplode("ws").alias("pos", "term"))
    return materialise(each.join(entries, "term").select("term", "id", "mark", "pos", "parts"), "postings")


def _listed(postings: DataFrame, plans: DataFrame) -> DataFrame:
    """Where each plan's rarest term is: (plan columns, id, mark, diagonal), a window of the item beginning ``diagonal``
    words after the document, less the window's place in the item."""
    dealt = postings.withColumn("part", F.pmod(F.xxhash64("id", "mark"), F.col("parts").cast("long"))).withColumnRenamed("term", "term1")
    copied = plans.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n1") / PART) - 1))).drop("n1")
    return dealt.join(copied, ["term1", "part"]).drop("part", "parts").withColumn("diagonal", F.col("pos") - F.col("offset1")).drop("pos")


def phrase_matches(docs: DataFrame, wins: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: int = 3) -> DataFrame:
    """Exact matches (id, mark, hits), one row for each text of an id that has any; hits is an array of structs (start, item,
    n) for windows of n words that begin at word ``start``. ``terms`` lists are intersected for a window."""
    wins = materialise(wins, "windows")
    chosen = materialise(window_terms(wins), "window_terms")
    counts = term_counts(docs, chosen.select("term"), text_col)
    here = Window.partitionBy("item", "at", "win")
    known = chosen.join(counts, "term", "left").withColumn("absent", F.max(F.col("n").isNull()).over(here)).filter("not absent")
    ranked = known.withColumn("rank", F.row_number().over(here.orderBy("n", "term"))).filter(F.col("rank") <= terms)
    named = [F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, terms + 1) for c in ("term", "offset", "n")]
    plans = materialise(ranked.groupBy("item", "at", "win").agg(*named), "window_plans")
    used = F.array(*[F.struct(F.col(f"term{k}").alias("term"), F.col(f"n{k}").alias("n")) for k in range(1, terms + 1)])
    postings = build_index(docs, plans.select(F.inline(used)).filter("term is not null"), id_col, text_col)

    lists = [c for k in range(1, terms + 1) for c in (f"term{k}", f"offset{k}")]
    met = _listed(postings, plans.select("item", *lists, "n1").distinct())
    for k in range(2, terms + 1):
        other = postings.select(F.col("term").alias("p_term"), F.col("id").alias("p_id"), F.col("mark").alias("p_mark"), F.col("pos").alias("p_pos"))
        same = (met[f"term{k}"] == other["p_term"]) & (met["mark"] == other["p_mark"]) & (met["diagonal"] + met[f"offset{k}"] == other["p_pos"]) & met["id"].eqNullSafe(other["p_id"])
        more = met.filter(F.col(f"term{k}").isNotNull()).join(other, same, "left_semi")
        met = materialise(met.filter(F.col(f"term{k}").isNull()).unionByName(more), f"met_{k}")

    p = plans.select(*[F.col(c).alias(f"p_{c}") for c in ("item", "at", "win", *lists)])
    uses = F.col("term1") == F.col("p_term1")
    for c in ("item", *lists[1:]):
        uses = uses & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    places = met.join(p, uses).select("id", "mark", "item", (F.col("diagonal") + F.col("p_at")).alias("start"), F.col("p_win").alias("win")).filter("start >= 0")
    found = materialise(places.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "item", "win")).alias("places")), "candidates")

    text = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("d_mark"), F.col(text_col).alias("text"))
    here = text["d_id"].eqNullSafe(found["id"]) & (text["d_mark"] == found["mark"])
    read = text.join(found, here).select("id", "mark", words(F.col("text")).alias("ws"), "places")
    # exploded, as a filter of ``places`` would split the text into words once for each place
    each = read.select("id", "mark", "ws", F.explode("places").alias("x"))
    each = each.filter(F.slice("ws", F.col("x.start") + 1, F.size("x.win")) == F.col("x.win"))
    hit = F.struct("x.start", "x.item", F.size("x.win").alias("n"))
    return each.groupBy("id", "mark").agg(F.collect_set(hit).alias("hits"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int, terms: int = 3, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item): documents that have the ``terms`` rarest of an item's words within ``span`` words of the rarest one, in
    any order.

    A null, empty or wordless item, and one with a word that no document has, matches none; null and empty documents match
    none; very long ones are indexed whole. A repeated word counts once; of words equally rare the one that sorts first is
    rarer. Items of one id and different words are each matched; repeated documents give one row. Null ids are ids like
    any other. Empty tables give no rows; further columns are ignored, whatever their names.
    """
    whole = benchmark.select(F.col(item_col).cast("string").alias("name"), words(F.col(text_col)).alias("win")).filter(F.size("win") > 0).distinct()
    whole = whole.withColumn("item", F.struct("name", F.xxhash64("win").alias("mark"))).withColumn("at", F.lit(0))
    chosen = materialise(window_terms(whole).select("item", "term"), "item_terms")
    counts = term_counts(docs, chosen.select("term"), text_col)
    here = Window.partitionBy("item")
    known = chosen.join(counts, "term", "left").withColumn("absent", F.max(F.col("n").isNull()).over(here)).filter("not absent")
    ranked = materialise(known.withColumn("rank", F.row_number().over(here.orderBy("n", "term"))).filter(F.col("rank") <= terms), "item_ranks")
    postings = build_index(docs, ranked.select("term", "n"), id_col, text_col)
    cell = F.floor(F.col("pos") / span)
    anchors = postings.join(ranked.filter("rank = 1").select("item", "term"), "term").select("item", "id", "mark", F.col("pos").alias("a_pos"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    rest = postings.join(ranked.select("item", "term", "rank"), "term").select("item", "id", "mark", "rank", "pos", cell.alias("cell"))
    rest = rest.select(*[F.col(c).alias(f"r_{c}") for c in ("item", "id", "mark", "cell")], "rank", "pos")
    same = (anchors["item"] == rest["r_item"]) & anchors["id"].eqNullSafe(rest["r_id"]) & (anchors["mark"] == rest["r_mark"]) & (anchors["cell"] == rest["r_cell"])
    near = anchors.join(rest, same).filter(F.abs(F.col("pos") - F.col("a_pos")) <= span)
    met = near.groupBy("item", "id", "mark", "a_pos").agg(F.countDistinct("rank").alias("met"))
    needed = ranked.groupBy("item").agg(F.count("*").alias("needed"))
    return met.join(needed, "item").filter("met = needed").select("id", F.col("item.name").alias("item")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id, ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window),
    ``n_items``, ``items_sha256`` (of their ids as strings, sorted and comma-joined) and ``contaminated``.

    Null and wordless texts have no words and no hits; wordless or null items have no windows. An item with a null id
    hits words but isn't counted or listed among the items. An empty table of documents gives no rows, one of
    benchmark items no hits. Very long texts are indexed whole. Repeated rows each get their row; ids may be null or repeat with other texts; further
    columns are ignored, whatever their names.
    """
    matches = phrase_matches(docs, windows(benchmark, width), id_col, text_col)
    lengths = docs.select(F.col(id_col).alias("id"), row_mark(text_col).alias("mark"), F.size(words(F.col(text_col))).alias("n_words"))
    hit = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    items = F.array_sort(F.array_compact(F.array_distinct(F.transform("hits", lambda h: h["item"]))))
    found = matches.select(F.col("id").alias("m_id"), F.col("mark").alias("m_mark"), F.size(F.array_distinct(hit)).alias("hit"), items.alias("items"))
    whole = lengths.join(found, lengths["id"].eqNullSafe(found["m_id"]) & (lengths["mark"] == found["m_mark"]), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay as they are. Edge cases as in
    ``contamination``."""
    matches = phrase_matches(docs, windows(benchmark, width), id_col, text_col)
    hit_id, hit_mark = free_names(docs, "hit_id", "hit_mark")
    found = matches.select(F.col("id").alias(hit_id), F.col("mark").alias(hit_mark))
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].eqNullSafe(found[hit_id]) & (mark == found[hit_mark]), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w)),
m AS (SELECT r, i, p.n, item FROM (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM p) p JOIN w ON p.win = w.win AND p.n = w.n),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
