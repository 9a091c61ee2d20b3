"""Removal of repeated passages, by recompression.

Recompression parses a word sequence in rounds: a round first names runs of one symbol, then splits the alphabet in two
by a bit of each name and names the pairs (left, right). A symbol's parse depends on a known interval of words only,
so whatever lies outside, equal passages get equal symbols inside. Names are hashes of what they stand for, so equal
content has one name in all documents without a dictionary that every round would have to join.

A window's anchor is the widest symbol of the highest round that has any whose interval lies inside the window, which its
words alone decide: two equal windows have one anchor name. Successive windows of one anchor make one row (name,
extent), extent being a hash of all their words. Spark keeps rows whose name is shared. Where a name's rows have one
extent, their windows are repeats; where they have several, single windows of these rows are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm.common import small
from somatrix.tables import materialise, table

#: Rounds, and the rounds before which runs are named too: each run's ends depend on its neighbours, which widens what a
#: symbol depends on, and after the first round of pairs runs are rare.
ROUNDS, RUN_ROUNDS = 4, (0,)
#: Bytes that are parsed at a time; longer texts are parsed in pieces that overlap by a window.
PIECE = 1 << 20
LONG_WORD = 256
SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of the polynomial hashes: of bytes in a word, of words in an extent, of words in a window.
BYTE_BASE, EXTENT_BASE, WINDOW_BASE = np.random.default_rng(2).integers(2**62, 2**63, 3, dtype=np.uint64) | np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_POWERS = powers(BYTE_BASE, LONG_WORD)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start and hash of each word."""
    a = np.frombuffer(raw, np.uint8)
    inside = ~((a == 0x20) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = ends - starts
    within = np.arange(len(a)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(a)]))
    terms = (a.astype(np.uint64) + np.uint64(1)) * BYTE_POWERS[np.minimum(within, LONG_WORD - 1)]
    terms[~inside] = 0
    out = mix(np.add.reduceat(terms, starts), 1) ^ mix(lengths.astype(np.uint64), 2)
    for i in np.flatnonzero(lengths >= LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], 3)
    return starts, out


def segments(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of word hashes: the hashes, where each segment starts in them, its text's number, its first word's number.

    Each window of ``width`` words is in exactly one segment: a text's segments overlap by ``width - 1`` words.
    """
    group: list[tuple[int, bytes]] = []
    size = 0
    past: tuple[int, int, np.ndarray] = (-1, 0, np.empty(0, np.uint64))

    def block():
        nonlocal past
        at, hashes = word_hashes(b" ".join(x for _, x in group))
        cuts = np.searchsorted(at, np.cumsum([0] + [len(x) + 1 for _, x in group]))
        parts, firsts = [], []
        for k, (i, _) in enumerate(group):
            own, first = hashes[cuts[k] : cuts[k + 1]], 0
            if past[0] == i:
                own, first = np.concatenate([past[2], own]), past[1]
            rest = min(width - 1, len(own))
            past = (i, first + len(own) - rest, own[len(own) - rest :])
            parts.append(own)
            firsts.append(first)
        lengths = np.array([len(x) for x in parts])
        return np.concatenate(parts), np.r_[0, np.cumsum(lengths)[:-1]], np.array([i for i, _ in group]), np.array(firsts)

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                found = SEPARATOR.search(text, end)
                end = found.start() if found else len(text)
            group.append((i, text[at:end]))
            size += end - at
            at = end
            if size >= PIECE:
                yield block()
                group, size = [], 0
    if group:
        yield block()


def parse(names: np.ndarray, starts: np.ndarray, width: int) -> list[tuple[np.ndarray, ...]]:
    """For each round from 0, its symbols that a window can hold: name, number of words, and the interval they depend on."""
    far = np.int64(1) << 40
    n = len(names)
    segment = np.zeros(n, np.int32)
    segment[starts[(starts > 0) & (starts < n)]] = 1
    segment = np.cumsum(segment, dtype=np.int32)  # empty segments don't matter: only changes do
    lo = np.arange(n, dtype=np.int64)
    hi = lo + 1
    words = np.ones(n, np.int64)
    levels = [(names, words, lo, hi)]
    for r in range(ROUNDS):
        # runs of one symbol
        joins = (names[1:] == names[:-1]) & (segment[1:] == segment[:-1])
        if r in RUN_ROUNDS and joins.any():
            at = np.flatnonzero(np.r_[True, ~joins])
            length = np.diff(np.r_[at, len(names)])
            last = at + length - 1
            run = length > 1
            beside_lo = np.where((at > 0) & (segment[at - 1] == segment[at]), lo[at - 1], -far)
            after = np.minimum(last + 1, len(names) - 1)
            beside_hi = np.where((last + 1 < len(names)) & (segment[after] == segment[at]), hi[after], far)
            named = names[at].copy()
            named[run] = mix(named[run] ^ mix(length[run].astype(np.uint64), 7), 4 * r + 3)
            names, segment, words = named, segment[at], np.add.reduceat(words, at)
            lo, hi = beside_lo, beside_hi
        elif r in RUN_ROUNDS:
            same = segment[1:] == segment[:-1]
            lo, hi = np.r_[-far, np.where(same, lo[:-1], -far)], np.r_[np.where(same, hi[1:], far), far]
        # pairs of a left and a right symbol
        left = (mix(names, 4 * r + 4) & np.uint64(1)).astype(bool)
        same = segment[1:] == segment[:-1]
        pair = np.r_[left[:-1] & ~left[1:] & same, False]
        second = np.r_[False, pair[:-1]]
        next_hi = np.r_[np.where(same, hi[1:], far), far]
        past_lo = np.r_[-far, np.where(same, lo[:-1], -far)]
        new_lo = np.where(left, lo, past_lo)  # a right symbol that isn't a pair's second had no left one before it
        new_hi = np.where(left, next_hi, hi)
        at = np.flatnonzero(pair)
        named = names.copy()
        named[at] = mix(names[at] * EXTENT_BASE + names[at + 1], 4 * r + 5)
        keep = ~second
        words = words + np.where(pair, np.r_[words[1:], 0], 0)
        names, words, segment, lo, hi = named[keep], words[keep], segment[keep], new_lo[keep], new_hi[keep]
        fits = hi - lo <= width
        levels.append((names[fits], words[fits], lo[fits], hi[fits]))
        if not fits.any():
            break
    return levels


def anchored(names: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Rows of successive windows with one anchor: first window, number of windows, anchor's name, hash of all words."""
    lengths = np.diff(np.r_[starts, len(names)])
    n = np.maximum(lengths - width + 1, 0)
    left = np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    total = len(left)
    window, anchor, name = left, np.full(total, -1, np.int64), np.zeros(total, np.uint64)
    todo, base = np.arange(total), 0
    for symbols, words, lo, hi in reversed(parse(names, starts, width)):
        i = window[todo]
        a, b = np.searchsorted(lo, i), np.searchsorted(hi, i + width, side="right")
        ok = a < b
        if ok.any():
            k = widest(words << np.int64(56) | (symbols >> np.uint64(8)).view(np.int64), a[ok], b[ok])
            anchor[todo[ok]] = base + k
            name[todo[ok]] = symbols[k]
            todo = todo[~ok]
        base += len(lo)
    if not total:
        return window, window, name, name
    at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    count = np.diff(np.r_[at, total])
    return window[at], count, name[at], spans(names, window[at], window[at] + count + width - 1, EXTENT_BASE)


def widest(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each range from a to b, where ``order`` is largest in it; the first of equal ones."""
    best, at = np.arange(len(order)), np.zeros(len(a), np.int64)
    length, span = b - a, 1
    while len(best):
        now = (length >= span) & (length < 2 * span)
        x, y = best[a[now]], best[b[now] - span]
        at[now] = np.where(order[y] > order[x], y, x)
        x, y = best[:-span], best[span:]
        best = np.where(order[y] > order[x], y, x)
        span *= 2
        if not (length >= span).any():
            break
    return at


def spans(names: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of word sequences."""
    inverse = np.uint64(pow(int(base), -1, 2**64))
    sums = np.r_[np.uint64(0), np.cumsum(mix(names, 6) * powers(base, len(names)), dtype=np.uint64)]
    return mix((sums[end] - sums[begin]) * powers(inverse, len(names) + 1)[begin], 8) ^ mix((end - begin).astype(np.uint64), 9)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def occurrences(docs: DataFrame, width: int) -> DataFrame:
    """(key, mark, first, n, name, extent): the rows of ``anchored``, for all of ``docs`` (key, mark, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for names, starts, text, first_word in segments(as_bytes(batch.column("text")), width):
                first, n, name, extent = anchored(names, starts, width)
                k = np.searchsorted(starts, first, side="right") - 1
                rows = pa.array(text[k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(rows), batch.column("mark").take(rows), pa.array(first - starts[k] + first_word[k], pa.int64()), pa.array(n.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(extent.view(np.int64))],
                    ["key", "mark", "first", "n", "name", "extent"],
                )

    return docs.select("key", "mark", "text").mapInArrow(run, "key long, mark int, first long, n int, name long, extent long")


def window_hashes(docs: DataFrame, width: int) -> DataFrame:
    """(one, two, key, mark, at, times): hashes of the windows that ``docs`` (key, mark, text, spans) lists, spans being
    an array of structs (first, n, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, asked = as_bytes(batch.column("text")), batch.column("spans").to_pylist()
            for names, starts, text, first_word in segments(texts, width):
                if not len(names):
                    continue
                ends = np.r_[starts[1:], len(names)]
                rows, at, times = [], [], []
                for s, (i, begin, end, f) in enumerate(zip(text, starts, ends, first_word, strict=True)):
                    for x in asked[i]:
                        a, b = max(x["first"], f), min(x["first"] + x["n"], f + end - begin - width + 1)
                        if a < b:
                            at.append(np.arange(a, b) - f + begin)
                            rows.append(np.full(b - a, s))
                            times.append(np.full(b - a, x["times"]))
                if not at:
                    continue
                where, s = np.concatenate(at), np.concatenate(rows)
                one, two = (spans(names, where, where + width, b).view(np.int64) for b in (EXTENT_BASE, WINDOW_BASE))
                docs_at = pa.array(text[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), batch.column("key").take(docs_at), batch.column("mark").take(docs_at), pa.array(where - starts[s] + first_word[s], pa.int64()), pa.array(np.concatenate(times), pa.int64())],
                    ["one", "two", "key", "mark", "at", "times"],
                )

    return docs.mapInArrow(run, "one long, two long, key long, mark int, at long, times long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, mark, text): key and mark, hashes of the id and the text, are never null and tell rows apart that repeat
    an id with another text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("key"), mark.alias("mark"), text.alias("text"))


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """(key, mark, first, end): word ranges that cover exactly the repeated windows of ``docs`` (key, mark, text)."""
    rows = materialise(occurrences(docs, width), "occurrences")
    # written, so that the join reads two plain shuffles, of which Spark can split a name's many rows
    names = materialise(rows.groupBy("name").agg(F.count("*").alias("times")).filter("times > 1").select("name"), "names")
    shared = materialise(rows.join(names, "name", "left_semi"), "shared")
    one = F.min(F.struct("key", "mark", "first", "n"))
    extents = materialise(shared.groupBy("name", "extent").agg(F.count("*").alias("times"), one.alias("one")), "extents")
    whole = shared.join(extents.filter("times > 1").select("name", "extent"), ["name", "extent"], "left_semi")
    whole = whole.select("key", "mark", "first", (F.col("first") + F.col("n") + width - 1).alias("end"))
    mixed = extents.groupBy("name").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("name")
    asked = extents.join(mixed, "name", "left_semi").select("times", "one.*")
    asked = asked.groupBy("key", "mark").agg(F.collect_list(F.struct("first", "n", "times")).alias("spans"))
    texts = docs.select("key", "mark", "text").join(asked, ["key", "mark"]).dropDuplicates(["key", "mark"])
    each = materialise(window_hashes(texts.select("key", "mark", "text", "spans"), width), "windows")
    twice = each.groupBy("one", "two").agg(F.sum("times").alias("times")).filter("times > 1").select("one", "two")
    single = each.filter("times = 1").join(twice, ["one", "two"], "left_semi")
    return whole.unionByName(single.select("key", "mark", F.col("at").alias("first"), (F.col("at") + width).alias("end")))


def without_spans(docs: DataFrame, spans_of: DataFrame) -> DataFrame:
    """``docs`` (id, key, mark, text) with n_words, n_removed and kept, the words outside ``spans_of`` joined by one space."""
    listed = spans_of.groupBy("key", "mark").agg(F.collect_set(F.struct("first", "end")).alias("cut"))
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            totals, removed, kept, digest = [], [], [], []
            for text, cut in zip(batch.column("text"), batch.column("cut"), strict=True):
                ws = text.as_py().encode().split()
                totals.append(len(ws))
                if cut.is_valid:
                    change = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(change, np.asarray(cut.values.field("first")), 1)
                    np.add.at(change, np.asarray(cut.values.field("end")), -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(totals[-1] - len(ws))
                whole = b" ".join(ws)
                kept.append(whole.decode())
                digest.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                ["id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    joined = docs.join(listed, ["key", "mark"], "left").select("id", "text", "cut")
    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id, ``n_words``, ``n_removed``, ``kept`` and ``kept_sha256``.

    Words are separated by space and the controls U+0009 to U+000D. Each word goes that a window covers whose ``width``
    words start anywhere else too, in the same text or another; ``kept`` is the rest, joined by one space. All
    occurrences go, the first one too. Windows are judged on the input.

    Null text has no words; a text of fewer than ``width`` words loses none. Repeated rows are each other's copies, so
    texts of ``width`` words or more lose all of them. An empty table gives no rows; ids may be null; further columns
    are ignored, whatever their names. Texts are parsed in pieces of bounded size, however long they are.
    """
    rows = keyed(docs, id_col, text_col)
    return without_spans(rows, repeated_spans(rows, width)).withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, i, hash(array_to_string(ws[i:i + 34], ' ')) AS h1, md5(array_to_string(ws[i:i + 34], ' ')) AS h2
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
twice AS (SELECT h1, h2 FROM p GROUP BY h1, h2 HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN twice USING (h1, h2)),
each_word AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(ws[k], ' ' ORDER BY k) AS t FROM each_word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
