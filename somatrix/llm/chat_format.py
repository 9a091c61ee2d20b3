"""Chat formatting by budgeted windows: turn-aligned spans, a retained system turn, limited history, a mask on what is new."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somatrix.llm import bpe
from somatrix.llm.common import small
from somatrix.llm.ranks import group_key, ranked
from somatrix.tables import table

#: Put behind the first character of a control string inside a text, once more than the text itself has it there.
JOINER = "\u2060"
#: What follows ``<`` or ``[`` in a control string. Neither character occurs anywhere else in one.
ANGLE, SQUARE = "/?s>", r"/?(?:INST|SYS|ROLE|TURN)\]"
#: Turns of a conversation that one task formats; windows and their history don't reach over the border.
BLOCK = 4096
TURN = re.compile(r"\[INST\](.*?)\[/INST\]|\[SYS\](.*?)\[/SYS\]|\[ROLE\](.*?)\[/ROLE\](.*?)\[/TURN\]|(.*?)</s>", re.DOTALL)
ESCAPED = re.compile(f"(<(?={JOINER}+{ANGLE})|\\[(?={JOINER}+{SQUARE})){JOINER}")
BYTES = 4 << 20


def escape(text: Column) -> Column:
    """``text`` without control strings: each gets a joiner behind its first character, and so does what looks like one
    that has got some. Other texts stay as they are."""
    return F.regexp_replace(text, f"<(?={JOINER}*{ANGLE})|\\[(?={JOINER}*{SQUARE})", f"$0{JOINER}")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def formatted_turn(role: Column, text: Column) -> Column:
    """A turn with its marks: ``[INST]..[/INST]`` for users, ``..</s>`` for assistants, ``[SYS]..[/SYS]`` for system
    turns, ``[ROLE]..[/ROLE]..[/TURN]`` for all other roles. ``text`` and other roles are escaped already."""
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("[SYS]"), text, F.lit("[/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE]"), role, F.lit("[/ROLE]"), text, F.lit("[/TURN]")))
    )


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of one window."""
    for user, system, role, other, assistant in (m.groups() for m in TURN.finditer(formatted, len("<s>"))):
        if user is not None:
            yield "user", unescape(user)
        elif system is not None:
            yield "system", unescape(system)
        elif role is not None:
            yield unescape(role), unescape(other)
        else:
            yield "assistant", unescape(assistant)


class _Windows:
    """Turns of one block in their order become windows; holds one window and the history that the next may repeat."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history

    def start(self, system: tuple[str, int] | None) -> None:
        self.system, self.turns, self.recent = system, [], deque()

    def add(self, rank: int, role: str, piece: str, tokens: int, upto: int) -> tuple | None:
        """Takes a turn that ends ``upto`` tokens into its block; gives a window if that closes one."""
        done, begin, room = None, upto - tokens, self.budget - (self.system[1] if self.system else 0)
        if self.turns and upto - self.base > (room if self.first else self.budget):
            done = self.close()
        if not self.turns:
            while self.recent and (begin - self.recent[0][0] > self.history or upto - self.recent[0][0] > room):
                self.recent.popleft()
            self.first, self.past = rank, [x[1] for x in self.recent]
            self.base = self.recent[0][0] if self.recent else begin
        self.turns.append((role, piece))
        self.upto = upto
        if rank == 0 and role == "system":
            self.system = piece, tokens
            return done
        self.recent.append((begin, piece))
        while self.recent and upto - self.recent[0][0] > self.history:
            self.recent.popleft()
        return done

    def close(self) -> tuple:
        retained = [self.system[0]] if self.system and self.first else []
        tokens = self.upto - self.base + (self.system[1] if retained else 0)
        parts, loss = ["<s>", *retained, *self.past], []
        at = sum(map(len, parts))
        for role, piece in self.turns:
            if role == "assistant":
                loss.append({"start": at, "end": at + len(piece) - len("</s>")})
            parts.append(piece)
            at += len(piece)
        self.turns = []
        return self.first, len(retained) + len(self.past), tokens, tokens > self.budget, "".join(parts), loss


WINDOW = "first_turn long, repeated int, n_tokens long, over boolean, formatted string, loss array<struct<start:int,end:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_windows(convs: DataFrame, ranks_path: str, pattern: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """``convs`` (conv_id, turn, role, text) as training windows: (conv_id, first_turn, repeated, n_tokens, over,
    formatted, loss).

    A window holds whole turns. It begins with the conversation's system turn if its first turn is one, then repeats up to
    ``history`` tokens of turns before, then goes on with new turns from ``first_turn`` (counted from 0) while all fit
    into ``budget`` tokens; running sums of the turns' tokens say which. ``repeated`` counts the turns before the new
    ones. Every turn is new in just one window. A turn that doesn't fit at all gets a window of its own, uncut, marked
    ``over``. ``loss`` are the code points to learn from: the texts of new assistant turns, without marks.

    Turns go by ``turn`` (null first), then by a digest of role and text. Null roles and texts count as empty; any role is
    allowed; null conv_id is a conversation; repeated rows are turns of their own; no rows give no windows; further columns
    are ignored. A conversation of any length is formatted in blocks of 4,096 turns, each by one task that holds a window
    at a time; history ends at a block's start.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.when(role.isin("user", "assistant", "system"), role).otherwise(escape(role))
    turns = convs.select("conv_id", group_key(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), formatted_turn(named, escape(text)).alias("piece"))
    turns = turns.withColumn("tie", F.sha2(F.concat("role", F.lit("\n"), "piece"), 256))
    turns = ranked(bpe.with_counts(turns, ranks_path, pattern, "piece", "tokens"), "conv", "turn", "tie")
    turns = turns.withColumn("block", F.expr(f"rank div {BLOCK}L"))
    system = turns.filter("rank = 0 AND role = 'system'").select("conv", F.col("piece").alias("system"), F.col("tokens").alias("system_tokens"))
    later = turns.filter(f"rank > 0 AND rank % {BLOCK} = 0").join(system, "conv", "left")
    rest = turns.filter(f"rank = 0 OR rank % {BLOCK} != 0")
    turns = rest.unionByName(later, allowMissingColumns=True)
    upto = F.sum("tokens").over(Window.partitionBy("conv", "block").orderBy("rank"))
    columns = ["conv", "block", "rank", "role", "piece", "tokens", "upto", "system", "system_tokens", "conv_id"]
    turns = turns.withColumn("upto", upto).select(columns).sortWithinPartitions("conv", "block", "rank")
    kind = dict(convs.dtypes)["conv_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, here, conv_id, id_type, out, size = _Windows(budget, history), None, None, None, [], 0

        def batch() -> pa.RecordBatch:
            ids = pa.array([x[0] for x in out], id_type)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), _LOSS)
            arrays = [pa.array([x[1][k] for x in out], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([ids, *arrays], ["conv_id", "first_turn", "repeated", "n_tokens", "over", "formatted", "loss"])

        for part in small(batches, "piece"):
            id_type = part.schema.field("conv_id").type
            for conv, block, rank, role, piece, tokens, upto, system, system_tokens, this in zip(*(c.to_pylist() for c in part.columns), strict=True):
                done = None
                if (conv, block) != here:
                    if here is not None:
                        out.append((conv_id, windows.close()))
                        size += len(out[-1][1][4])
                    here, conv_id = (conv, block), this
                    windows.start((system, system_tokens) if system is not None else None)
                done = windows.add(rank, role, piece, tokens, upto)
                if done:
                    out.append((conv_id, done))
                    size += len(done[4])
                if size > BYTES:
                    yield batch()
                    out, size = [], 0
        if here is not None:
            out.append((conv_id, windows.close()))
        if out:
            yield batch()

    return turns.mapInArrow(build, f"conv_id {kind}, {WINDOW}")


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation of ``windows``, from their text and mask alone: conv_id, n_turns, turns_sha256 (role,
    line feed, text, line feed for each turn), loss_chars, loss_sha256, formatted_chars, n_windows, n_tokens, n_over.

    Windows of a conversation go through one task in their order, one at a time, as the digest of a whole needs it.
    """
    kind = dict(windows.dtypes)["conv_id"]
    ordered = windows.withColumn("conv", group_key(F.col("conv_id"))).repartition("conv").sortWithinPartitions("conv", "first_turn")
    ordered = ordered.select("conv", "conv_id", "repeated", "n_tokens", "over", "formatted", "loss")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows", "n_tokens", "n_over"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, found, id_type = None, [], None

        def batch() -> pa.RecordBatch:
            for row in found:
                row[2], row[4] = row[2].hexdigest(), row[4].hexdigest()
            columns = list(zip(*found, strict=True))
            types = [id_type, *(pa.string() if c in ("turns_sha256", "loss_sha256") else pa.int64() for c in names[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for part in small(batches, "formatted"):
            id_type = part.schema.field("conv_id").type
            for conv, conv_id, repeated, tokens, over, formatted, loss in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if conv != here:
                    if len(found) >= 4096:
                        yield batch()
                        found = []
                    here = conv
                    found.append([conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0])
                row = found[-1]
                for k, (role, text) in enumerate(parsed(formatted)):
                    if k >= repeated:
                        row[1] += 1
                        row[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    learned = unescape(formatted[span["start"] : span["end"]])
                    row[3] += len(learned)
                    row[4].update(learned.encode())
                row[5] += len(formatted)
                row[6] += 1
                row[7] += tokens
                row[8] += over
        if found:
            yield batch()

    types = {"conv_id": kind, "turns_sha256": "string", "loss_sha256": "string"}
    return ordered.mapInArrow(read, ", ".join(f"{n} {types.get(n, 'long')}" for n in names))


def op11_chat_formatting(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted in windows and read back from them."""
    import public_tokenizers

    marks = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(format_windows(convs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN))
