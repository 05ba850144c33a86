"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

The permutation maps row numbers 0..n-1 onto themselves.  A permuted number p
lies in shard p mod k at slot p div k, so both can be computed from the row
number alone, shards differ by one row at most, and slots have no gap.

Defined cases: an empty table gives no rows; null keys are numbered first;
rows that tie on every ordering column, repeated rows too, are interchangeable
and get distinct places; empty and very long texts are rows as any other, and
null texts count no bytes; an input column named like an output column is
replaced, any other name may occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import free_name
from weirflow.llm.numbering import number_rows

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser; only its low bits are used."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def round_keys(seed: int) -> list[int]:
    """A key for each round, by the fixed mixer alone, so that no library's random numbers matter."""
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed % 2**64)]


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The image of each row number under the permutation of 0..n-1 that ``seed`` picks."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(seed)
    out = rows.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int, order: list[str], *, seed: int = 1, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All columns and rows of ``docs`` with shard and slot; ``order`` fixes the row numbers.

    Equal rows are interchangeable; different rows that tie on ``order`` should be told apart by further columns in it.
    """
    kept = docs.drop(*(c for c in docs.columns if c.lower() in (shard_col.lower(), slot_col.lower())))
    (number,) = free_name(kept, "row_no")
    numbered, n = number_rows(kept, order, number)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(shard_col, T.IntegerType()), T.StructField(slot_col, T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(np.asarray(batch.column(batch.schema.get_field_index(number))), n, seed)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=[*names, shard_col, slot_col])

    return numbered.mapInArrow(place, schema)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the size that shards are measured by, UTF-8 bytes plus 16, and the text's CRC-32; a null text has no bytes."""
    return docs.withColumns({"size": (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long"), "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
