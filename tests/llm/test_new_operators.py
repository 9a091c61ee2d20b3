"""Chat formatting, the filter audit and the Merkle manifest against plain Python, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from somatrix.llm import bpe, chat_format, filter_audit, merkle, queries, ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CONVS = "conv_id long, turn long, role string, text string, conv string, block long, tokens string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digit_cell string, same string, trie string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Ranks


def test_ranks_equal_a_sort_and_split_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CROWDED", 50)
    random.seed(3)
    rows = [("a", random.choice([None, 5, random.getrandbits(62) - (1 << 61), random.randrange(9000)]), sha(str(random.randrange(40)))) for _ in range(900)]
    rows += [("b", -(1 << 63), "x"), ("b", (1 << 63) - 1, "y"), ("b", None, "z"), ("", 1, "x")]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, k long, t string"), "g", "k", "t").collect()
    for g in ("a", "b", ""):
        order = sorted((k is not None, k or 0, t) for h, k, t in rows if h == g)
        mine = sorted((r["rank"], r["k"] is not None, r["k"] or 0, r["t"], r["total"]) for r in got if r["g"] == g)
        assert [x[0] for x in mine] == list(range(len(order)))
        assert [x[1:4] for x in mine] == order and {x[4] for x in mine} == {len(order)}
    assert ranks.ranked(spark.createDataFrame([], "g string, k long, t string"), "g", "k", "t").count() == 0


# Chat formatting


def conversations():
    random.seed(5)
    words = ["alpha", "beta</s>", "[INST]", "<s>", "[/SYS]", "⁠", "[⁠INST]", "<⁠⁠/s>", "[TURN]", "naïve", "日本", "\\", "a[0]<b", "\n"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = []
    for conv in range(12):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * random.randrange(1, 12) + ["user"] * (conv % 2)
        rows += [(conv, t, role, text(random.choice([0, 1, 5, 40])), "c", 7, "t") for t, role in enumerate(roles)]
    rows += [(None, None, None, None, "c", 7, "t"), (None, 0, "tool[/ROLE]", "x</s>", "c", 7, "t"), (50, 3, "assistant", None, "c", 7, "t")]
    rows += [(51, 1, "system", "late", "c", 7, "t"), (51, 0, "assistant", "first", "c", 7, "t"), (51, 1, "system", "late", "c", 7, "t")]
    return rows + [(52, 0, "system", "s", "c", 7, "t"), (52, 1, "user", "long " * 50_000, "c", 7, "t"), (52, 2, "assistant", "ok", "c", 7, "t")]


def wanted(rows):
    """The contract's digests, by conversation. Ties of a turn are of equal rows here."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = sorted(turns)
        learned = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), sha(learned))
    return out


@pytest.mark.parametrize(("budget", "history", "block"), [(2048, 512, 4096), (40, 15, 4096), (60, 30, 4)])
def test_windows_read_back(spark, monkeypatch, budget, history, block):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rows = conversations()
    windows = chat_format.format_windows(spark.createDataFrame(rows, CONVS), PATH, PATTERN, budget, history).cache()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(windows).collect()}
    assert got == wanted(rows)
    systems = {r[0]: r[3] for r in rows if r[2] == "system" and r[1] == 0}
    model = bpe.ByteBPE(bpe.parse_ranks(open(PATH, "rb").read()), PATTERN)
    for w in windows.collect():
        turns = list(chat_format.parsed(w["formatted"]))
        new = len(turns) - w["repeated"]
        assert new >= 1 and w["over"] == (w["n_tokens"] > budget)
        if w["over"]:
            assert new == 1 and w["repeated"] <= 1
        if w["conv_id"] in systems:
            assert turns[0] == ("system", systems[w["conv_id"]])
            assert w["first_turn"] == 0 or w["repeated"] >= 1
        spans = [chat_format.unescape(w["formatted"][a:b]) for a, b in w["loss"]]
        assert spans == [t for role, t in turns[w["repeated"] :] if role == "assistant"]
        assert w["n_tokens"] <= len(model.encode(w["formatted"])) // 4 * 2 + 20
    windows.unpersist()


def test_windows_are_filled(spark):
    """A window ends only where the next turn doesn't fit, and repeats no more than the history allows."""
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"word{t} " * 5) for t in range(1, 60)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = sorted(chat_format.format_windows(convs, PATH, PATTERN, 200, 60).collect(), key=lambda w: w["first_turn"])
    model = bpe.ByteBPE(bpe.parse_ranks(open(PATH, "rb").read()), PATTERN)
    size = lambda role, text: len(model.encode({"user": f"[INST]{text}[/INST]", "assistant": f"{text}</s>", "system": f"[SYS]{text}[/SYS]"}[role])) // 4
    tokens = [size(r, t) for _, _, r, t in rows]
    firsts = [w["first_turn"] for w in windows]
    for w, nxt in zip(windows, [*firsts[1:], len(rows)], strict=True):
        first = w["first_turn"]
        past = w["repeated"] - (first > 0)
        used = sum(tokens[first - past : nxt]) + (tokens[0] if first else 0)
        assert used == w["n_tokens"] <= 200 and sum(tokens[first - past : first]) <= 60
        assert nxt == len(rows) or used + tokens[nxt] > 200
        if first > 1 and first - past > 1:  # one more turn of history wouldn't do
            more = sum(tokens[first - past - 1 : first])
            assert more > 60 or more + tokens[first] + tokens[0] > 200


def test_chat_query_and_empty_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.QUERIES["op11_chat_formatting"](spark, sf_dir).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == wanted(rows)
    assert chat_format.read_back(chat_format.format_windows(spark.createDataFrame([], CONVS), PATH, PATTERN)).count() == 0


# Filter audit


def documents():
    random.seed(9)
    words = [f"w{i}" for i in range(300)] + ["CAPS", "Mixed", "a#b", "x\ty"]
    text = lambda n, k: " ".join(random.choice(words[-k:]) for _ in range(n))
    texts = [None, "", "one", "ONE TWO", *[text(random.choice([3, 199, 200, 260]), random.choice([4, 90, 304])) for _ in range(50)]]
    texts += [texts[9], texts[9], texts[20], "", " \t " + texts[8], "word " * 60_000]
    rows = [(i, t, random.choice(["en", "fr", None]), random.choice(["s1", "s2", None, ""]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[9], None, None, None), (None, texts[9], "é", "s1", 3), (7, "other", "en", "s1", -1)]
    return [(*r, "d", "s", "t") for r in rows]


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 50, 3)] + [(3, 1, 1), (3, None, None), (None, 1, 1), (999, 1, 1)]


def brute_audit(rows, labels):
    split = lambda t: [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    counts, shapley = defaultdict(Counter), Counter()
    for i, t, _, part, *_ in rows:
        t, part, words = t or "", part or "", split(t or "")
        failed = {f for f, yes in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(set(t) & set("#$%&*|")), i is not None and i > least[t]), strict=True) if yes}
        for order in map("".join, permutations("ABCDE")):
            first = next((k for k, f in enumerate(order, 1) if f in failed), 6)
            for step, f in enumerate(order, 1):
                c = counts[part, order, step]
                c.update(kept=first > step, removed=first == step, redundant=f in failed and first < step, unique_fails=failed == {f}, good_lost=first == step and i in good, toxic_lost=first == step and i in toxic)
                shapley[part, f] += first == step
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*key, *(c[n] for n in names), shapley[key[0], key[1][key[2] - 1]]) for key, c in counts.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("common", [1000, 4])
def test_audit(spark, monkeypatch, common):
    monkeypatch.setattr(filter_audit, "COMMON", common)
    docs, labels = spark.createDataFrame(documents(), DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.with_labels(filter_audit.text_flags(docs), labels)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_audit(documents(), LABELS)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.with_labels(filter_audit.text_flags(docs), labels)).count() == 0


@pytest.mark.parametrize("name", ["op12_filter_interaction_audit", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(sql.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[sql.columns.index(c)] for c in columns) for r in sql.fetchall())


# Merkle manifest


def tree(nodes, fanout):
    """The node that is left, and the siblings of each at every level, left and right of it."""
    siblings, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for p in run:
                for leaf in below[p]:
                    siblings[leaf].append(("".join(nodes[q] for q in run if q < p), "".join(nodes[q] for q in run if q > p)))
        nodes, below = [sha("".join(nodes[q] for q in run)) for run in runs], [sum((below[q] for q in run), []) for run in runs]
    return nodes[0], siblings


def leaf(row, more=0):
    i, text, lang, source, n = row[:5]
    fields = (i, source, lang, None if n is None else n + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_manifest(rows, fanout):
    parts = defaultdict(list)
    for row in rows:
        parts[row[2]].append(row)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for part, own in parts.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[part] = tree([leaf(r) for r in own], fanout)
    root, top = tree([trees[p][0] for p in order], fanout)
    out = []
    for p, above in zip(order, top, strict=True):
        for row, low in zip(parts[p], trees[p][1], strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            x = leaf(row, int(bad))
            for left, right in low + above:
                x = sha(left + x + right)
            out.append((row[0], leaf(row), trees[p][0], root, sha("".join(a + b for a, b in low + above)), x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fanout", "reduced"), [(2, 4096), (2, 4), (3, 9)])
def test_manifest(spark, monkeypatch, tmp_path, fanout, reduced):
    monkeypatch.setattr(merkle, "REDUCED", reduced)
    rows = documents() + [(100, "x", lang, "s", 1, "d", "s", "t") for lang in ("", "a", "ab", "abcdefgh", "abcdefgi", "zé", "Z")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (fanout,))
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == brute_manifest(rows, fanout)


def test_manifest_of_one_and_of_none(spark):
    rows = spark.createDataFrame([(1, "a", "l", "l")], "id long, part string, leaf string, presented string")
    one = merkle.manifest(rows).first()
    assert (one["path"], one["subroot"], one["root"]) == ([], "l", "l")
    assert merkle.manifest(rows.filter(F.lit(False))).count() == 0


def test_bpe_words_between_spaces_are_encoded_and_remembered_once():
    import numpy as np
    import tiktoken

    ranks, rng = bpe.read_ranks(PATH), random.Random(6)
    model, letters = bpe.ByteBPE(ranks, PATTERN), "abcdeghilnorstéÉłªǅɏжЖ漢"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    for mark in ("", ",", "'s", "7"):
        text = " ".join(word + mark for word in ["", *words])
        assert np.frombuffer(model.encode(text), "<u4").tolist() == own.encode_ordinary(text)
    assert set(words[1:]) <= {**model.spaced.older, **model.spaced}.keys()
    assert not any(f" {word}" in model.piece for word in words)  # a word with a mark behind it is the word that stands alone
    halves = bpe.ByteBPE(ranks, PATTERN.replace(r" ?\p{L}+", r" ?\p{L}{1,4}"))
    assert not halves.one_piece and halves.encode(" abcdefgh") != model.encode(" abcdefgh")
