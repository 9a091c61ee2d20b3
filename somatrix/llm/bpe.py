"""Byte-level BPE by backtracking from longest matches.

A token sequence is the encoding of its bytes exactly where each adjacent pair is: where merging the bytes of the two
gives those two tokens back. So no merges are run over a text. From each position the longest token comes first, found
by an Aho-Corasick automaton over bytes as Latin-1 characters; a token that doesn't go with the one before it gives way
to the longest of its own prefixes, and a position from which nothing goes on is never entered again. Since each
prefix of the bytes has one encoding only, every position is left for good once, and time is linear in the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from somatrix.llm.common import by_bytes, small
from somatrix.tables import table

#: Chunks that a memo holds at most, the longest chunk that it takes, pairs of tokens and edges of tokens that
#: other memos hold, and bytes of text in an output batch.
MEMO, LONGEST, PAIRS, EDGES, PIECE = 600_000, 48, 400_000, 100_000, 2 << 20
#: Of chunks whose characters all come before this one it is known without the pattern's library whether they are letters:
#: both know the same ones.
LATIN = "\u0250"
#: Above every rank.
NEVER = 1 << 60
#: In the tables of halves: not looked up yet, and none.
UNKNOWN, NONE = -2, -1


def parse_ranks(vocabulary: bytes) -> list[tuple[bytes, int]]:
    """Tokens and their ranks, from lines of a token in base64 and its rank."""
    return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, vocabulary.splitlines())]


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as file:
        return parse_ranks(file.read())


class Memo(dict):
    """Encodings of short chunks, ``MEMO`` at most, some 120 MB as a rule. When half of that is new, what wasn't asked for
    since the last time is forgotten."""

    def __init__(self, f):
        self.f, self.older = f, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.f(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMO // 2:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class Pairs(dict):
    """Results by pair of numbers, or by one number that stands for a pair, ``most`` of them. When half of that is new, what
    wasn't asked for since the last time is forgotten."""

    def __init__(self, f, most: int):
        self.f, self.most, self.older = f, most, {}

    def __missing__(self, key):
        out = self.older[key] if key in self.older else self.f(key)
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class ByteBPE:
    """Encoder for one vocabulary and one pattern that cuts texts into pieces."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.rank = dict(ranks)
        self.places = places = max(self.rank.values()) + 1
        self.token, self.size = [b""] * places, [0] * places
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks:
            self.token[rank], self.size[rank] = token, len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(token) for token in self.token]
        self.halves = array("i", [UNKNOWN]) * places, array("i", [UNKNOWN]) * places
        self.edges, self.follow = Pairs(self._edge, EDGES), Pairs(self._follow, PAIRS)
        self.piece = Memo(self._piece)
        self.spaced = Memo(self._spaced)
        self.one_piece = r" ?\p{L}+" in pattern.split("|") and all(self.pieces.findall(x) == [x] for x in (" a", " \u00e9t\u00c9\u0142", " Zz" + "aB\u00aa\u01c5\u024f" * 40))

    def _shorter(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix of this one."""
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), None)

    def _half(self, rank: int, side: int) -> int:
        """The token at one side (0: the start) of the merge that makes this one; none for single bytes and for tokens
        that merges never make."""
        if self.halves[side][rank] == UNKNOWN:
            parts = [self.token[rank][i : i + 1] for i in range(len(self.token[rank]))]
            while len(parts) > 2:
                best, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made = [self.rank.get(x, NONE) for x in parts] if len(parts) == 2 else [NONE]
            if NONE not in made and not all(len(x) == 1 or self._half(r, 0) != NONE for x, r in zip(parts, made, strict=True)):
                made = [NONE]
            for k in (0, 1):
                self.halves[k][rank] = NONE if NONE in made else made[k]
        return self.halves[side][rank]

    def _edge(self, key: tuple[int, int]) -> list[tuple[int, int]] | None:
        """The tokens that stand at one edge of a token (side 0: its start, 1: its end) while its bytes are merged, from
        a single byte to the whole, each with the rank of the merge that ends it. None if merges never make the token."""
        (rank, side), out, ends = key, [], NEVER
        while True:
            out.append((rank, ends))
            half = self._half(rank, side)
            if half == NONE:
                return out[::-1] if len(self.token[rank]) == 1 else None
            rank, ends = half, rank

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of both tokens merge to these two: no merge over their border comes before it is ruled out.
        Of equal ranks the left merge comes first."""
        left, right = self.edges[pair[0], 1], self.edges[pair[1], 0]
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            over = self.rank.get(self.token[a] + self.token[b], NEVER)
            if over != NEVER and over < a_ends and over <= b_ends:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _follow(self, pair: int) -> int | None:
        """The longest token that goes with the one before it, of the second of a pair (``places`` times the first one's rank, and
        the second's) and its own prefixes."""
        left, right = divmod(pair, self.places)
        while right is not None and not self._fits((left, right)):
            right = self.shorter[right]
        return right

    def _piece(self, text: str) -> bytes:
        """The encoding of one piece: the longest matches as far as they go together, then by backtracking."""
        raw = text.encode()
        whole = self.rank.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        size, follow, shorter, places = self.size, self.follow, self.shorter, self.places
        n, letters, matches = len(raw), raw.decode("latin-1"), self.automaton.iter_long
        out: list[int] = []
        at, before, token = 0, -1, None
        for end, token in matches(letters):
            if end - size[token] != at - 1:  # bytes that no token begins with were skipped
                token = None
                break
            if before >= 0 and follow[before + token] != token:
                break
            out.append(token)
            at, before = end + 1, token * places
        else:
            token = None
        if at == n:
            return struct.pack(f"<{len(out)}I", *out)
        closed: list[int] = []
        while at < n:
            while token is not None:
                if out:
                    token = follow[out[-1] * places + token]
                if not closed or token is None or at + size[token] not in closed:
                    break
                token = shorter[token]
            if token is None:
                if not out:
                    raise ValueError(f"the vocabulary can't encode {raw!r}")
                closed.append(at)
                last = out.pop()
                at -= size[last]
                token = shorter[last]
            else:
                out.append(token)
                at += size[token]
                if at < n:
                    end, token = next(matches(letters, at), (at, None))
                    if token is not None and end + 1 - size[token] != at:
                        token = None
        return struct.pack(f"<{len(out)}I", *out)

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(text)))

    def _spaced(self, chunk: str) -> bytes:
        """The encoding of a space and a chunk. If the pattern takes a space and letters as one piece, they aren't cut again; a piece
        that follows from a space is remembered once."""
        if self.one_piece and chunk.isalpha() and max(chunk) < LATIN:
            return self._piece(" " + chunk)
        first, *rest = self.pieces.findall(" " + chunk) or [""]
        if not rest:
            return self._piece(first)
        begin = self.spaced[first[1:]] if self.one_piece and first[0] == " " and first[1:].isalpha() else self.piece[first]
        return begin + b"".join(map(self.piece.__getitem__, rest))

    #: Before a space between two characters that aren't white space, every piece of such a pattern ends.
    BREAK = regex.compile(r"(?<=\S)(?= \S)")
    DOUBLE = re.compile(r"\s\s")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Texts are cut before single spaces, and the parts remembered."""
        if not self.DOUBLE.search(text):
            first, *rest = text.split(" ")
            return self._chunk(first) + b"".join(map(self.spaced.__getitem__, rest))
        first, *rest = self.BREAK.split(text)
        return self._chunk(first) + b"".join(self.spaced[x[1:]] for x in rest)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[tuple, ByteBPE] = {}


def _model(shared) -> ByteBPE:
    """One model in each Python worker and vocabulary."""
    vocabulary, pattern = shared.value
    key = (hash(vocabulary), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(parse_ranks(vocabulary), pattern)
    return _made[key]


def _share(df: DataFrame, ranks_path: str, pattern: str):
    """The vocabulary as a broadcast: a file of fixed size, read on the driver, that no input makes larger."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for every row of ``docs``; ids holds the token ids as little-endian unsigned 32-bit integers.

    ``pattern`` cuts a text into pieces, each encoded by itself, as byte-pair merges in order of rank would, a piece
    that is itself a token as that token; no special tokens. The pattern must be of the usual form, whose pieces hold
    a space only at their start or among white space. Null and empty texts have no tokens; a text of any length is
    encoded whole, in memory that follows its own length; repeated rows and rows of one id each get their row; ids may be
    null; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    return _encoded(docs, ranks_path, pattern, id_col, text_col, True, False)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with ``decoded``, the bytes that the ids stand for."""
    kind = dict(encoded.dtypes)["id"]
    shared = _share(encoded, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in parse_ranks(shared.value[0])}
        for batch in small(batches, "ids"):
            decoded = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "n_tokens", "ids"]).columns, pa.array(decoded, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary")


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, with_ids: bool, with_digests: bool) -> DataFrame:
    """id and n_tokens, the ids if asked for, and if asked for the digests of the ids and of what they decode to. One
    Python task does all of it, so that a core holds one copy of the vocabulary."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["id"]
    shared = _share(docs, ranks_path, pattern)
    names = ["id", "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * with_digests]
    types = {"id": kind, "n_tokens": "long", "ids": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for a, b in by_bytes(texts, PIECE):
                ids = [model.encode(x) for x in texts[a:b]]
                columns = [batch.column("id")[a:b], pa.array([len(x) // 4 for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                if with_digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                    columns.append(pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(run, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))


def with_counts(df: DataFrame, ranks_path: str, pattern: str, text_col: str, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of one of its columns, which may hold nulls (no tokens). Edge cases as in ``encode``."""
    shared = _share(df, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in small(batches, text_col):
            counts = [len(model.encode(x or "")) // 4 for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema, StructField(name, LongType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id, ``n_tokens``, ``ids``, and SHA-256 of the ids and of the bytes they decode to.
    Edge cases as in ``encode``."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, True, True).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``round_trip`` without the ids."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, False, True).withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
