"""The text operators against plain Python over small tables, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from test_near_text import brute_kept

from somatrix.llm import bpe, decontaminate, exact_dedup, language_id, pii, quality, sharding, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, digest string, id string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def make(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if t else None, "s", len(t or ""), "x", "y", "z") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_for_edges():
    random.seed(7)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ÉTÉ", "naïve", "日本", "A-b", "x\ty"]
    passage = " ".join(random.choice(words) for _ in range(60))
    long = " ".join(random.choice(words) for _ in range(5000))
    base = [" ".join(random.choice(words) for _ in range(80)) for _ in range(8)]
    return [None, "", " \t\n", "Word", "word", "WORD", "...", *base, base[0].upper(), base[0], base[0], f"{base[1]} {passage} {base[2]}", f"{passage} end", "ha " * 200, long, long + " tail", "a b", "A B", passage]


@pytest.fixture(scope="module")
def edge(spark):
    texts = texts_for_edges()
    ids = list(range(len(texts) - 3)) + [3, 4, None]
    return list(zip(ids, texts, strict=True)), make(spark, texts, ids)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_exact_groups(edge, empty):
    table, df = edge
    groups = defaultdict(list)
    for i, t in table:
        groups[lower(t)].append(i)
    want = []
    for i, t in table:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append([i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()])
    assert rows(exact_dedup.exact_groups(df, salts=3), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and sorted(lower(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def brute_substrings(table, width):
    words = [(t or "").encode().split() for _, t in table]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(table, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append([i, len(w), len(gone), hashlib.sha256(kept).hexdigest()])
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [35, 5, 1])
def test_substring_dedup(edge, empty, width):
    table, df = edge
    assert rows(substring_dedup.substring_dedup(df, width), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(table, width)
    assert substring_dedup.substring_dedup(empty, width).count() == 0


def test_substring_pieces(edge, monkeypatch):
    """Texts longer than a piece give the rows that whole texts give."""
    texts = [(t or "").encode() for _, t in edge[0]]

    def windows(piece):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        found = Counter()
        for names, starts, text, first in substring_dedup.segments(texts, 35):
            at, n, name, _ = substring_dedup.anchored(names, starts, 35)
            k = np.searchsorted(starts, at, side="right") - 1
            for s, a, m, x in zip(k, at, n, name, strict=True):
                for w in range(m):
                    found[int(text[s]), int(a - starts[s] + first[s] + w), int(x)] += 1
        return found

    assert windows(1 << 20) == windows(500) and max(windows(500).values()) == 1


def brute_contamination(table, items, width=10):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]

    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            wins[tuple(w[k : k + width])].add(item)
    out = []
    for i, t in table:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append([i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)])
    return sorted(out, key=repr)


def test_contamination(spark, edge, empty):
    table, df = edge
    items = [(1, table[7][1][20:160]), (2, "Word"), (10, table[9][1]), (11, None), (12, "..."), (13, table[9][1]), (None, "naïve"), (14, "w1 w2 nowhere w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.contamination(df, bench), *columns) == brute_contamination(table, items)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(df, bench.filter("false")).filter("contaminated").count() == 0
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not r[-1] for r in brute_contamination(table, items))


def test_texts_split_once(spark, edge):
    """A text that is compared with its candidates is split into words once, not once for each place."""
    bench = spark.createDataFrame([(1, edge[0][7][1][20:160])], "item_id long, text string")
    found = decontaminate.phrase_matches(edge[1], decontaminate.windows(bench, 10))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_proximity(spark):
    docs = make(spark, ["alpha x x beta y gamma", "alpha " + "x " * 50 + "beta gamma", "gamma beta alpha", "alpha beta"])
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert rows(decontaminate.proximity_matches(docs, bench, 8), "id", "item") == [[0, "1"], [2, "1"]]


def brute_fingerprint(text):
    w = lower(text).encode().split()
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[find(i)] += [x] if x is not None else []
    return [min(least[find(i)], default=None) for i in range(len(fps))]


def test_near_groups(edge, empty):
    table, df = edge
    fps = [brute_fingerprint(t) for _, t in table]
    parts = brute_near([i for i, _ in table], fps)
    want = sorted(([i, f"{f:016x}", p] for (i, _), f, p in zip(table, fps, parts, strict=True)), key=repr)
    assert rows(simhash.near_groups(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(empty).count() == 0
    assert simhash.near_dedup(df).columns == df.columns and simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("split_above", [1024, 3])
def test_fingerprint_links(spark, split_above):
    """Clusters, chains and far points, also where buckets are split."""
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            x ^= 1 << rng.randrange(64)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(80)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    from somatrix.operators.graph import components

    found = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(df, 2, split_above)).collect()}
    parts = brute_near(fps, fps)
    groups, want = defaultdict(set), defaultdict(set)
    for x, p in zip(fps, parts, strict=True):
        groups[found.get(simhash.signed(x), simhash.signed(x))].add(x)
        want[p].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bpe(spark, edge, empty):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
    table, df = edge
    want = []
    for i, t in table:
        ids = encoding.encode_ordinary(t or "")
        want.append([i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()])
    assert rows(bpe.digests(df, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.digests(empty, path, pattern).count() == 0
    model, rng = bpe.ByteBPE(bpe.read_ranks(path), pattern), random.Random(3)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "\r\n", "\x85", "\xa0", "　", "\x1c", "1", "é", "ß", "日本", "🙂", "'s", "...", "%%%", "\x00", "​"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert model.encode(text) == np.array(encoding.encode_ordinary(text), "<u4").tobytes(), repr(text)


def test_sharding(spark, edge, empty):
    docs = make(spark, [str(i % 7) for i in range(1000)]).repartition(5)
    found = sharding.shard_rows(docs, [F.col("doc_id")]).toPandas()
    sizes = found.groupby("shard").size()
    assert sorted(found["doc_id"]) == list(range(1000)) and len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert abs(np.corrcoef(found["doc_id"], found["shard"])[0, 1]) < 0.15
    assert sharding.shard_rows(edge[1], [F.col("doc_id")]).count() == len(edge[0])
    assert sharding.shard_rows(empty, [F.col("doc_id")]).count() == 0
    assert sharding.shard_rows(docs.withColumnsRenamed({"lang": "part", "source": "__row", "content": "row"}), [F.col("part"), F.col("__row"), F.col("row")]).count() == 1000
    matrix = sharding.communication_matrix([10, 0, 7, 3], [5, 5, 5, 5], 1)
    assert matrix.sum(axis=0).tolist() == [5, 5, 5, 5] and matrix.sum(axis=1).tolist() == [10, 0, 7, 3]


@pytest.mark.parametrize("good, bad, n", [(5, 7, 4), (1, 3, 2), (40, 2, 41), (300, 200, 100)])
def test_hypergeometric_law(good, bad, n):
    rng, draws = np.random.default_rng(8), 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(draws))
    law = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(seen) <= set(law)
    likely = {k: draws * p for k, p in law.items() if draws * p >= 5}
    assert sum((seen[k] - e) ** 2 / e for k, e in likely.items()) < len(likely) - 1 + 4 * (2 * len(likely)) ** 0.5


def test_hypergeometric_at_any_size():
    rng, good, total, n = np.random.default_rng(8), 10**12 // 24, 10**12, 10**11
    seen = np.array([sharding.hypergeometric(rng, good, total - good, n) for _ in range(2000)]) - n * good / total
    spread = math.sqrt(n * good / total * (1 - good / total) * (total - n) / (total - 1))
    assert abs(seen.mean()) < 4 * spread / 2000**0.5 and abs(seen.std() / spread - 1) < 0.07
    assert sharding.log_falling(10**12, 10**6) == pytest.approx(float(np.log(np.arange(10**12 - 10**6 + 1, 10**12 + 1, dtype=float)).sum()), rel=1e-12)


def test_matrix_law(spark):
    """First lines of two partitions against all deals, and lines from tasks."""
    seen, n = Counter(), 4000
    for seed in range(n):
        seen[tuple(sharding.communication_matrix([3, 4], [2, 3, 2], seed)[0].tolist())] += 1
    law = {(a, b, 3 - a - b): math.comb(2, a) * math.comb(3, b) * math.comb(2, 3 - a - b) / math.comb(7, 3) for a in range(3) for b in range(4) if 0 <= 3 - a - b <= 2}
    assert set(seen) == set(law) and sum((seen[k] - n * p) ** 2 / (n * p) for k, p in law.items()) < 25
    sizes = spark.createDataFrame([(i, 5 + i % 3) for i in range(40)], "part long, n long")
    lines = {r["part"]: np.diff([0, *r["ends"]]) for r in sharding.matrix_lines(sizes, [80, 79, 80], 3, group=7).collect()}
    assert all(lines[i].sum() == 5 + i % 3 for i in range(40)) and sum(lines.values()).tolist() == [80, 79, 80]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def luhn(d):
        total = 0
        for k, x in enumerate(reversed(d)):
            y = int(x) * (1 + k % 2)
            total += y - 9 if y > 9 else y
        return total % 10 == 0

    out = [(m.start(), 1, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 3, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 4, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_patterns():
    rng = random.Random(4)
    parts = ["a", "B.c", "@", "x@y.z", ".", "-", "12", "255", "256", "007", "1.2.3.4", " ", "+", "+1 (225) 555-3104", "4556737586899855", "(", ")", "%", "é", "a@b", "c.d", "4", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.pattern_spans(text) == brute_spans(text), repr(text)
    assert pii.pattern_spans("1" * 50_000 + "@" + "a" * 50_000) == []


def test_pii_field(spark, edge, empty):
    docs = make(spark, ["call +1 (225) 555-3104 or later 555-3104 again", "card 4556737586899855 then x4556737586899855", "year 2020 and 2020 clean", None, "", *["mail a.b@c.example.org and +1 (835) 555-4595 now", "number 4987654321098769 ip 1.2.3.4"] * 20])
    found = {r["doc_id"]: r for r in pii.find_pii(docs, pii.fit(docs)).collect()}
    assert found[0]["base"] == "phone:5:22" and found[0]["n_phone"] == 1
    assert found[0]["spans"] == "phone:5:22,phone:32:40"
    assert found[1]["n_added"] == 0 and found[1]["spans"] == found[1]["base"] == "card:5:21,card:28:44"
    assert found[2]["spans"] == found[3]["spans"] == found[4]["spans"] == ""
    assert all(set(x for x in r["base"].split(",")) <= set(r["spans"].split(",")) for r in found.values())
    assert pii.redact("call +1 (225) 555-3104 or", "phone:5:22") == "call [phone] or"
    assert pii.find_pii(empty, pii.fit(empty)).count() == 0 and pii.find_pii(edge[1], pii.fit(edge[1])).count() == len(edge[0])


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(spark, n=600):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "su") for b in ("na", "te", "lo", "mi", "du")]
    texts, toxic, low = [], [], []
    for i in range(n):
        bad, junk = i % 9 == 0, i % 5 == 0
        t = [rng.choice(words) for _ in range(40)]
        if bad:
            t[rng.randrange(40)] = rng.choice(["gorkish", "gorkard", "flumpe"])
        texts.append(" ".join(w + "***" if junk else w for w in t))
        toxic.append(int(bad))
        low.append(int(not junk))
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(low, toxic, strict=True))], "doc_id long, quality int, toxic int")
    return make(spark, texts), labels, toxic, low


def test_toxicity(spark, edge, empty):
    docs, labels, toxic, _ = labelled(spark)
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    right = [(found[i] >= toxicity.CUT) == bool(y) for i, y in enumerate(toxic) if held(i)]
    assert np.mean(right) > 0.95
    scored = toxicity.score_toxicity(edge[1], model)
    assert scored.count() == len(edge[0]) and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(empty, model).count() == 0 and toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert toxicity.score_toxicity(edge[1], None).filter("score <> 0").count() == 0


def test_nn_pu_prefers_toxic_features():
    """Toxic documents have features 0 and 1, a tenth of the unlabelled ones too, all others 1 alone."""
    at, row = np.array([0, 1, 1, 0, 1]), np.array([0, 0, 1, 2, 2])
    toxic, n = np.array([1, 0, 0]), np.array([20, 90, 10])
    w = toxicity.nn_pu(lambda w: toxicity.part_of_risk(toxic, n, row, at, w), 2, 100, 20, 0.1)
    assert toxicity.sigmoid(w[0] + w[1] + w[2]) > 0.5 > toxicity.sigmoid(w[1] + w[2])


def test_toxic_features_match(spark, edge):
    """What Spark's functions count and what the tasks look up are the same features."""
    table, df = edge
    counted = {r["feature"]: r["p"] for r in toxicity.toxic_features(df).collect()}
    names = sorted(counted)
    assert dict(zip(names, toxicity.unlabelled_counts(df, names).tolist(), strict=True)) == counted
    want = Counter(f for _, t in table for f in {f for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for f in toxicity.word_features(w)})
    assert counted == {f: n for f, n in want.items() if n >= toxicity.FEWEST}


@pytest.mark.parametrize("tasks", [3, 100])
def test_risk_sums(spark, tasks, monkeypatch):
    """Sums over Spark's rows are those over all rows at once; the driver gets no more of them than it may."""
    rng = random.Random(2)
    rows = [(rng.randrange(2), sorted(rng.sample(range(6), rng.randrange(4))), rng.randrange(1, 9)) for _ in range(40)]
    w = np.linspace(-1, 1, 7)
    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    whole = toxicity.risk(spark.createDataFrame(rows, "toxic int, at array<int>, n long").repartition(tasks), w, tasks)
    assert [len(x) for x in got] == [min(tasks, toxicity.SUMS)]
    want = np.zeros(15)
    for y, at, n in rows:
        if y:
            z, x = w[at].sum() + w[-1], np.bincount([*at, 6], minlength=7)
            want += n * np.r_[np.log1p(np.exp(z)), x / (1 + np.exp(-z)), -x / (1 + np.exp(z))]
    assert np.allclose(whole[1], want)


def test_quality(spark, edge, empty):
    docs, labels, _, good = labelled(spark)
    model = quality.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert np.mean([(found[i] >= 0.5) == bool(y) for i, y in enumerate(good) if held(i)]) > 0.95
    scored = quality.score_quality(edge[1], model)
    assert scored.count() == len(edge[0]) and scored.filter("score is null or isnan(score)").count() == 0
    assert quality.score_quality(empty, model).count() == 0 and quality.fit(docs, labels.filter("false")) is None


def test_quality_pool(spark):
    """Counts and draws of all unlabelled documents, over two rounds, are those of plain numpy."""
    rng = np.random.default_rng(3)
    content = rng.random((300, quality.TEXT_BUCKETS + quality.N_STATS)).astype(np.float16)
    meta = [sorted({int(x) for x in rng.integers(0, quality.META_BUCKETS, 4)}) for _ in range(300)]
    pool = spark.createDataFrame([(i, c.tobytes(), m, i / 300) for i, (c, m) in enumerate(zip(content, meta, strict=True))], "doc_id long, content binary, meta array<int>, draw double").repartition(7)
    weights = [[rng.normal(0, 0.2, content.shape[1] + 1), rng.normal(0, 1, quality.META_BUCKETS + 1)] for _ in range(2)]

    def scores(w):
        return np.stack([content.astype(np.float32) @ w[0][:-1].astype(np.float32) + w[0][-1], [w[1][m].sum() + w[1][-1] for m in meta]])

    counts = quality.tally(pool, [(weights[0], None)])
    assert counts.sum(axis=1).tolist() == [300, 300]
    bounds = [quality.limits(c, 0.4) for c in counts]
    free = np.ones(300, bool)
    for z, (first, last), n in zip(quality.bins(scores(weights[0])), bounds, counts, strict=True):
        assert n[first:].sum() >= 6 > n[first + 1 :].sum() and n[: last + 1].sum() >= 9 > n[:last].sum()
        free &= (z < first) & (z > last)
    stages = [(weights[0], bounds), (weights[1], None)]
    again = quality.tally(pool, stages)
    assert again.sum(axis=1).tolist() == [free.sum()] * 2
    stages[1] = weights[1], [quality.limits(c, 0.4) for c in again]
    for view, (found, tags, y) in enumerate(quality.drawn(pool, stages, np.array([[1, 1], [0.5, 0.5]]), spark.range(0, 300, 3).toDF("doc_id"))):
        z, (first, last) = quality.bins(scores(weights[1]))[view], stages[1][1][view]
        sure = free & ((z >= first) | (z <= last)) & (np.arange(300) / 300 < (1, 0.5)[view]) & (np.arange(300) % 3 > 0)
        assert sorted(map(bytes, found.astype(np.float16))) == sorted(map(bytes, content[sure])) and y.sum() == (z[sure] >= first).sum()
        assert sorted(tags.sum(axis=1)) == sorted(len(meta[i]) for i in np.flatnonzero(sure))
    assert quality.limits(np.zeros(10, int), 0.4) == (10, -1) and quality.limits(np.array([0, 900, 0]), 0.5) == (1, 0)


def test_language(spark, edge, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit_mixture(language_id.training_rows(docs))
    found = language_id.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r["lang_pred"] == r["lang"] for r in found if held(r["doc_id"])]
    assert np.mean(tested) > 0.95
    edges = language_id.predict_languages(edge[1], model).collect()
    assert len(edges) == len(edge[0]) and all(0 <= r["score"] <= 1 for r in edges)
    assert [r["lang_pred"] for r in edges][:3] == ["und"] * 3 and edges[6]["lang_pred"] == "und"
    assert language_id.predict_languages(empty, model).count() == 0 and language_id.fit_mixture(empty.select("text", "lang")) is None
    clash = language_id.keep_identified(edge[1].withColumnRenamed("digest", "__letters"), model)
    assert "__letters" in clash.columns and clash.count() == language_id.keep_identified(edge[1], model).count()
    kept = language_id.keep_identified(edge[1], model)
    assert kept.columns == edge[1].columns and kept.filter("text is null or text = ''").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    first = c.identify_language(spark, docs, sf_dir)
    table = [(r["doc_id"], r["text"]) for r in first.collect()]
    latest = {}
    for i, t in table:
        latest[lower(t)] = max(i, latest.get(lower(t), i))
    table = [(i, t) for i, t in table if latest[lower(t)] == i]
    table = [table[i] for i in brute_kept(table)]
    dirty = {r[0] for r in brute_contamination(table, bench) if r[-1]}
    want = {i for i, _ in table if i not in dirty}
    found = c.run(spark, sf_dir)
    assert {r["doc_id"] for r in found.collect()} == want and first.columns == docs.columns
    digests = {r["doc_id"]: r["decoded_sha256"] for r in found.select("doc_id", "decoded_sha256").collect()}
    assert all(digests[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in table if i in want)
