"""The pipeline's near-duplicate stage against all pairs of documents."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from somatrix import tables
from somatrix.llm import near_text, simhash
from somatrix.operators import graph

SCHEMA = "doc_id long, text string"


def brute_kept(table):
    """Positions of the rows that stay."""
    sets = []
    for _, t in table:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(table)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    groups = {}
    for i, x in enumerate(root):
        groups.setdefault(x, []).append(i)
    return sorted(min(g, key=lambda i: (table[i][0] is None, table[i][0] or 0)) for g in groups.values())


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def test_near_dedup(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(80)]
    table = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for times in (0, 1, 2, 3, 5, 8):
            table.append(" ".join(edited(rng, base, times)))
        table.append(" ".join(base + passage))
    table += ["ha " * 200, "ha " * 200 + "one", "ha " * 200 + "one two three four five six seven", "a b", "A  b", "a b c", None, "", " \n", "Word"]
    table = [(i, t) for i, t in enumerate(table)]
    rng.shuffle(table)
    table = [*table, (None, table[0][1]), (None, "only here with a null id")]
    found = simhash.near_dedup(spark.createDataFrame(table, SCHEMA))
    want = [table[i] for i in brute_kept(table)]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in found.collect()))) == sorted(map(repr, want))
    assert found.columns == ["doc_id", "text"]
    twice = spark.createDataFrame([(1, "some words of one row"), (1, "some words of one row"), (1, "quite other words")], SCHEMA)
    assert simhash.near_dedup(twice).count() == 2
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_drops_edited_copies(spark, sf_dir):
    """Pairs at similarity 0.8 that are more than two fingerprint bits apart."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:60], "edit", *words[61:130], "edit", *words[131:]]), "ha " * 200 + "one", "ha " * 200 + "two three four five six seven"]
    near = spark.createDataFrame([(10**9 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in c.drop_near_copies(spark, docs.unionByName(near), sf_dir).collect()}
    assert {10**9, 10**9 + 2, 10**9 + 3} <= kept and 10**9 + 1 not in kept


def test_documents_of_one_key_are_told_apart(spark, monkeypatch):
    """Keys that meet by chance lose no row."""
    monkeypatch.setattr(near_text, "row_key", lambda *parts: F.xxhash64(*parts) if len(parts) > 2 else F.pmod(F.xxhash64(*parts), F.lit(5)))
    table = [(i, f"text {i} of its own words a{i} b{i} c{i}") for i in range(30)] + [(3, "text 3 of its own words a3 b3 c3"), (None, "x"), (0, "x"), (None, None), (40, "")]
    keyed, repeated = near_text.with_keys(spark.createDataFrame(table, SCHEMA), "k", "doc_id", "text")
    keys = {(r["doc_id"], r["text"]): r["k"] for r in keyed.collect()}
    assert repeated and len(set(keys.values())) == len(keys) == 34
    assert simhash.near_dedup(spark.createDataFrame(table, SCHEMA)).count() == 32


def test_lists_of_unlike_documents_are_compared_in_blocks(spark, monkeypatch):
    """Many documents share a passage and nothing else; few pairs are listed, and no link is lost."""
    monkeypatch.setattr(near_text, "COMMON", 10**9)  # so that the passage isn't put last
    monkeypatch.setattr(near_text, "APART", 0)
    monkeypatch.setattr(near_text, "BLOCK", 16)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(12))
    table = []
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        table.append((len(table), f"{' '.join(own)} {passage}"))
        if i % 10 == 0:
            table.append((len(table), f"{' '.join(edited(rng, own, 1))} {passage}"))
    docs = spark.createDataFrame(table, SCHEMA)
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    lists = near_text.prefix_lists(texts).withColumn("root", F.col("key"))
    pairs = {(r["a"], r["b"]) for r in near_text.pairs_left(lists, near_text.sketches(texts)).collect()}
    want = brute_kept(table)
    gone = {i for i in range(len(table)) if i not in want}
    assert lists.groupBy("s").count().agg(F.max("count")).first()[0] > 25 and len(pairs) < 50
    assert len(gone) >= 10 and {(i - 1, i) for i in gone} <= pairs
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == want


def test_near_copies_of_a_list_give_a_forest(spark, monkeypatch):
    """A group of near copies that nothing joins yet gives fewer pairs than documents, and the whole job the same rows."""
    monkeypatch.setattr(near_text, "COMMON", 10**9)
    monkeypatch.setattr(near_text, "APART", 0)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    table = [(i, " ".join(edited(rng, base, 2))) for i in range(60)]
    docs = spark.createDataFrame(table, SCHEMA)
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    lists = near_text.prefix_lists(texts).withColumn("root", F.col("key"))
    groups, documents = lists.groupBy("s").count().filter("count > 1").agg(F.count("*"), F.sum("count")).first()
    assert near_text.pairs_left(lists, near_text.sketches(texts), forest=True).count() <= documents - groups
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == brute_kept(table)


def test_fine_sketches_tell_long_texts_apart():
    """Fine sketches never differ in more bits than sets in shingles, whatever their sizes, and don't fill up."""
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    for own in (50, 400, 1500, 4000):
        one, other = (np.unique(np.r_[shared, rng.integers(0, 2**63, k, dtype=np.uint64)]) for k in (own, own + 900))
        fine = [near_text.parities(x, near_text.fine_size(len(x))) for x in (one, other)]
        assert near_text._fine_differ(*fine) <= len(np.setxor1d(one, other))
    one, other = (np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64)) for _ in range(2))
    coarse = [near_text.parities(x, near_text.SKETCH) for x in (one, other)]
    fine = [near_text.parities(x, near_text.fine_size(len(x))) for x in (one, other)]
    assert 9 * near_text._fine_differ(*coarse) <= len(one) + len(other) < 9 * near_text._fine_differ(*fine)
    assert near_text.fine_size(1024) == 0 and near_text.fine_size(1025) == 32


def test_lists_of_one_block_are_not_dealt_out(spark, monkeypatch):
    """Rows of a list of a thousand documents go to one task each once, and the pairs are those of many small blocks."""
    monkeypatch.setattr(near_text, "COMMON", 10**9)
    monkeypatch.setattr(near_text, "APART", 0)
    rng = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(12))
    owns = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(500)]
    table = [(2 * i + j, f"{' '.join(edited(rng, own, j))} {passage}") for i, own in enumerate(owns) for j in range(2)]
    texts = spark.createDataFrame(table, SCHEMA).select(F.col("doc_id").alias("key"), "text")
    lists, sketched = near_text.prefix_lists(texts).withColumn("root", F.col("key")), near_text.sketches(texts)
    assert lists.groupBy("s").count().agg(F.max("count")).first()[0] > 512
    whole = near_text.pairs_left(lists, sketched)
    assert "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(near_text, "BLOCK", 64)
    dealt = near_text.pairs_left(lists, sketched)
    assert "Generate" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in whole.distinct().collect()} == {tuple(r) for r in dealt.distinct().collect()}
    monkeypatch.setattr(near_text, "APART", 10**6)
    assert near_text.pairs_left(lists, sketched, forest=True) is None


def test_few_links_take_one_stored_table_and_the_same_roots(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (400, 2))] + [(5, 5), (None, 3)]
    for links in (spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(f"é{a}", f"é{b}") for a, b in rows], "a string, b string")):
        stored, real = [], graph.materialise
        monkeypatch.setattr(graph, "materialise", lambda df, label: stored.append(label) or real(df, label))
        few = sorted(map(tuple, graph.components(links).collect()))
        assert stored == ["links"]
        monkeypatch.setattr(graph, "FEW", 0)
        assert few == sorted(map(tuple, graph.components(links).collect())) and len(stored) > 2
        monkeypatch.undo()
    assert graph.components(links.limit(0)).count() == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum("shuffle" in str(x) for x in tracker.getAllFiles().mkString("\n").split("\n"))

    before, kept = shuffled(), spark.conf.get(tables.CLEANUP, "false")
    stored = tables.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "stored")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and stored.count() == 7 and spark.conf.get(tables.CLEANUP, "false") == kept
