"""Helpers that the text operators share."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast way to do so where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def held_out(doc_id: Column) -> Column:
    """The fold that no label may be learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: A group of more than one row in so many is large; fewer groups than this are.
COMMON = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """``rows`` with the columns of their group: a left join with ``groups`` by the text ``key`` that no large group
    burdens a task with. ``size`` counts a group's rows, ``total`` all rows.

    The large groups, fewer than ``COMMON``, are broadcast; their rows then go by ``spread``, a text that is no key.
    """
    rest = [c for c in groups.columns if c != key]
    large = groups.filter(F.col(size) > total // COMMON).select(key, F.struct(*rest).alias("large_group"))
    small = groups.filter(F.col(size) <= total // COMMON).select(F.col(key).alias("small_key"), F.struct(*rest).alias("small_group"))
    met = rows.join(F.broadcast(large), key, "left")
    met = met.withColumn("small_key", F.when(F.col("large_group").isNull(), F.col(key)).otherwise(spread)).join(small, "small_key", "left")
    return met.select(*rows.columns, F.coalesce("large_group", "small_group").alias("group")).select(*rows.columns, *[f"group.{c}" for c in rest])


def by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``most`` bytes each, so that memory doesn't follow a batch's longest texts."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def small(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of one column each, so that what a task makes of a batch stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
