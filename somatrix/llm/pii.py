"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to similar tokens.

The field's nodes are a text's tokens that hold a digit or an at sign, and its keys: equal tokens, equal last seven
digits, equal names before the at sign. Chain edges join neighbouring tokens; skip edges join each repeated key with
its tokens, wherever they are, so that any two of them are two edges apart, however often they repeat. Tokens inside
pattern matches are observed; loopy sum-product messages label the others. A token is added where it likely is an
entity and so are the key that ties it to others and one of those. The weights are trained by pseudo-likelihood on the
patterns' own matches, in all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm.common import small
from somatrix.tables import table

KINDS = ("email", "ip", "card", "phone")
N = len(KINDS) + 1  # label 0: none
#: Training steps, and how sure a label must be: of tokens that a key ties to a match, and of those whose key has no match.
STEPS, RATE, DECAY, SURE, SURE_ALONE = 300, 0.1, 0.01, 0.5, 0.95
#: Messages have converged when none changes by more than this; loops that never settle are left after so many rounds.
STILL, ROUNDS = 1e-4, 500
#: What equal labels at both ends of a skip edge are worth before any training; training starts and shrinks to this.
SKIP_PRIOR = 4.0

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails at the start of a run of digits fails at each of its digits, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NEEDED = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(x * 2 - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, kind from 1, sorted; kinds may overlap each other."""
    out = []
    if "@" in text:
        last = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 1, m.end()))
                last = m.end()
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), 2, m.end()) for m in IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 3, m.end()))
        if "+" in text:
            out += [(m.start(), 4, m.end()) for m in PHONE.finditer(text) if 9 <= sum(x in "0123456789" for x in m[0]) <= 15]
    return sorted(out)


class Field:
    """A text's graph: its tokens, their features, observed labels (-1: none), chain edges, and for each key that two or
    more tokens have those tokens; keys of the same tokens count once."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        having: dict[str, list[int]] = {}
        at, reach, past = 0, [], -1
        for n, m in enumerate(TOKEN.finditer(text)):
            if not NEEDED.search(m[0]):
                continue
            start, end = m.start(), m.end()
            while end > start and text[end - 1] in ".,;:!?\"'":
                end -= 1
            while start < end and text[start] in "\"'<":
                start += 1
            token = text[start:end]
            while at < len(base) and base[at][0] < end:
                reach.append(base[at])
                at += 1
            reach = [x for x in reach if x[2] > start]
            i = len(self.spans)
            self.spans.append((start, end))
            self.label.append(min((x[1] for x in reach if x[0] < end), default=-1))
            beside = past == n - 1 and i > 0
            if beside:
                self.chain.append((i - 1, i))
            past = n
            self.features.append(token_features(token, beside))
            for key in token_keys(token):
                having.setdefault(key, []).append(i)
        self.keys = list(dict.fromkeys(tuple(tokens) for tokens in having.values() if len(tokens) > 1))

    def open_ends(self) -> bool:
        """Whether a key ties an unobserved token to another."""
        return any(self.label[i] < 0 for tokens in self.keys for i in tokens)


#: Names of the binary features, in their order.
FEATURES = ("always", "at sign", "dot after at", "plus first", "parenthesis", "hyphen", "letters", "three dots", "luhn", "beside", *(f"{n} digits or more" for n in (1, 4, 7, 9, 12, 16, 20)))


def token_features(token: str, beside: bool) -> list[int]:
    digits = "".join(x for x in token if x in "0123456789")
    have = [True, "@" in token, "." in token.partition("@")[2], token[:1] == "+", "(" in token, "-" in token, any(x.isalpha() for x in token), token.count(".") == 3, 12 <= len(digits) <= 19 and luhn(digits), beside]
    have += [len(digits) >= n for n in (1, 4, 7, 9, 12, 16, 20)]
    return [i for i, x in enumerate(have) if x]


#: Features that a token must have, and those that it must not, for each label from 1 on.
SHAPES = [
    [[FEATURES.index(x) for x in names] for names in kind]
    for kind in ((["at sign"], []), (["three dots"], ["at sign"]), (["luhn"], []), (["7 digits or more"], ["at sign", "16 digits or more"]))
]


def impossible(features: list[int]) -> list[int]:
    """The labels that a token with these features can't have."""
    return [k for k, (needed, barred) in enumerate(SHAPES, 1) if not set(needed) <= set(features) or set(barred) & set(features)]


#: Without a match to tie it to, a token is a telephone number only if it is written as one.
WRITTEN = {FEATURES.index(x) for x in ("plus first", "parenthesis", "hyphen")}


def token_keys(token: str) -> list[str]:
    digits = "".join(x for x in token if x in "0123456789")
    keys = [f"t{token.lower()}"] if len(token) >= 4 else []
    if len(digits) >= 7:
        keys.append(f"d{digits[-7:]}")
    name, sign, _ = token.lower().partition("@")
    return [*keys, f"e{name}"] if sign and name else keys


def training_rows(docs: DataFrame) -> DataFrame:
    """(features, label, left, right, skips, n): how often a token with these features has this label beside these and
    with keys of these labels. Labels of absent and unknown neighbours are -1; a key has the least label that others of its
    tokens are observed with, or 0. Tokens that a key ties to a match, but aren't in one, are left out, since whether they
    are entities is what the field is to say. Tokens and keys take a bounded number of forms, however many texts there
    are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                if not text or not DIGIT.search(text) and "@" not in text:
                    continue
                field = Field(text, pattern_spans(text))
                n = len(field.spans)
                left, right, skips = [-1] * n, [-1] * n, [[] for _ in range(n)]
                label, unsure = [max(x, 0) for x in field.label], [False] * n
                for a, b in field.chain:
                    left[b], right[a] = label[a], label[b]
                for tokens in field.keys:
                    seen = sorted((field.label[i], i) for i in tokens if field.label[i] > 0)
                    for i in tokens:
                        others = [x for x, j in seen[:2] if j != i]
                        skips[i].append(others[0] if others else 0)
                        unsure[i] |= bool(others) and field.label[i] < 0
                rows += [(field.features[i], label[i], left[i], right[i], sorted(skips[i])) for i in range(n) if not unsure[i]]
            ints = pa.list_(pa.int32())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (ints, pa.int32(), pa.int32(), pa.int32(), ints)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["features", "label", "left", "right", "skips"])

    rows = docs.select("text").mapInArrow(run, "features array<int>, label int, left int, right int, skips array<int>")
    return rows.groupBy("features", "label", "left", "right", "skips").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """Weights: token (feature, label), chain (label, label) and skip (label, label), by pseudo-likelihood over all of
    ``docs``. What comes to the driver is a count for each form of a token and its neighbourhood."""
    rows = training_rows(docs.select(F.col(text_col).alias("text"))).orderBy(F.desc("n"), "features", "label", "left", "right", "skips").collect()
    nf = len(FEATURES)
    x = np.zeros((len(rows), nf + 3 * N))
    y = np.zeros(len(rows), np.int64)
    weight = np.zeros(len(rows))
    for i, r in enumerate(rows):
        x[i, r["features"]] = 1
        for at, labels in ((0, [r["left"]]), (1, [r["right"]]), (2, r["skips"])):
            for k in labels:
                if k >= 0:
                    x[i, nf + at * N + k] += 1
        y[i], weight[i] = r["label"], r["n"]
    w = np.zeros((nf + 3 * N, N))
    w[nf + 2 * N :] = np.eye(N) * SKIP_PRIOR
    prior, first, second = w.copy(), np.zeros_like(w), np.zeros_like(w)
    weight /= max(weight.sum(), 1)
    for step in range(1, STEPS + 1 if rows else 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        gradient = x.T @ (p * weight[:, None]) + DECAY / 100 * (w - prior)
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    left, right, skip = (w[nf + k * N : nf + (k + 1) * N] for k in range(3))
    # one potential for each edge: the mean of what its two ends say of each other
    return {"token": w[:nf], "chain": (left + right.T) / 2, "skip": (skip + skip.T) / 2}


def marginals(field: Field, model: dict[str, np.ndarray]) -> np.ndarray:
    """(node, label), tokens first and then keys, by loopy sum-product messages, all at once each round and damped by half,
    until they stay as they are."""
    n = len(field.spans)
    node = np.zeros((n + len(field.keys), N))
    for i, features in enumerate(field.features):
        node[i] = model["token"][features].sum(axis=0)
        node[i, impossible(features)] = -1e9
    seen = np.array(field.label)
    observed = np.flatnonzero(seen >= 0)
    node[observed] = -1e9
    node[observed, seen[observed]] = 0
    for k, tokens in enumerate(field.keys, n):  # as in training, a key is what its matches are
        known = min((field.label[i] for i in tokens if field.label[i] > 0), default=0)
        if known:
            node[k] = -1e9
            node[k, known] = 0
    skip = [(i, n + k) for k, tokens in enumerate(field.keys) for i in tokens]
    edges = np.array(field.chain + skip, np.int64).reshape(-1, 2)
    pair = np.concatenate([np.broadcast_to(model[x], (len(y), N, N)) for x, y in (("chain", field.chain), ("skip", skip))])
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    potential = np.concatenate([pair, pair.transpose(0, 2, 1)])
    half = len(edges)
    back = np.r_[np.arange(half, 2 * half), np.arange(half)]
    message = np.zeros((2 * half, N))
    for _ in range(ROUNDS):
        total = node.copy()
        np.add.at(total, target, message)
        out = (total[source] - message[back])[:, :, None] + potential
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - message).max(initial=0.0)
        message = 0.5 * message + 0.5 * new
        if moved <= STILL:
            break
    total = node.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of tokens outside ``base`` that the field labels like a key of theirs and another of its tokens."""
    field = Field(text, base)
    if not field.open_ends():
        return []  # no token that a label could be carried to
    p = marginals(field, model)
    best, top, found = p.argmax(axis=1), p.max(axis=1), set()
    for k, tokens in enumerate(field.keys, len(field.spans)):
        tied = any(field.label[i] > 0 for i in tokens)
        least = SURE if tied else SURE_ALONE
        same = [i for i in tokens if best[i] == best[k] > 0 and top[i] >= least]
        if not tied:
            same = [i for i in same if KINDS[best[i] - 1] != "phone" or WRITTEN & set(field.features[i])]
        if len(same) > 1 and top[k] >= least:
            found.update(i for i in same if field.label[i] < 0)
    return [(field.spans[i][0], int(best[i]), field.spans[i][1]) for i in sorted(found)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind - 1]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_pii(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id, the number of pattern matches of each kind, ``base`` (those matches), ``spans``
    (these and what the field adds) and ``n_added``. Spans are written kind:start:end, in code points, the end exclusive,
    by start and then kind, comma-joined.

    Null and empty texts have none; very long texts are searched whole. Repeated rows each get their row; ids may be null; an empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]
    names = [*(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = pattern_spans(text or "")
                more = added_spans(text, base, model) if text and NEEDED.search(text) else []
                rows.append((*(sum(x[1] == k for x in base) for k in range(1, N)), written(base), written(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

    types = ", ".join(f"{x} {'string' if x in ('base', 'spans') else 'long'}" for x in names)
    return slim.mapInArrow(run, f"id {kind}, {types}").withColumnRenamed("id", id_col)


def redact(text: str, spans: str) -> str:
    """``text`` with each span, and each run of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",") if x):
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")

