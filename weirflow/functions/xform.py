"""Stateless steps on key and value, given as functions of Columns so that Catalyst sees through them.

``python_step`` takes an opaque function over pandas batches where Columns don't suffice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest number of values that a dynamic fan-out may give a row, more are an error; fixes the order of its rows in seq.
FAN_OUT = 1 << 10

Step = Callable[[DataFrame], DataFrame]
KV = Callable[[Column, Column], Column]


def _k() -> Column:
    return F.col("key")


def _v() -> Column:
    return F.col("value")


def map_kv(key: KV, value: KV) -> Step:
    return lambda df: df.withColumns({"key": key(_k(), _v()), "value": value(_k(), _v())})


def transform_key(f: Callable[[Column], Column]) -> Step:
    return lambda df: df.withColumn("key", f(_k()))


def transform_value(f: Callable[[Column], Column]) -> Step:
    return lambda df: df.withColumn("value", f(_v()))


def filter_kv(pred: KV) -> Step:
    return lambda df: df.where(pred(_k(), _v()))


def key_pred(f: Callable[[Column], Column]) -> Step:
    return lambda df: df.where(f(_k()))


def value_pred(f: Callable[[Column], Column]) -> Step:
    return lambda df: df.where(f(_v()))


def flat_map(f: Callable[[Column, Column], Sequence[tuple[Column, Column]]]) -> Step:
    """As many rows as ``f`` lists pairs, in that order."""

    def step(df: DataFrame) -> DataFrame:
        pairs = f(_k(), _v())
        rows = F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in pairs))
        rest = [c for c in df.columns if c not in ("key", "value", "seq")]
        out = df.select(*rest, "seq", F.posexplode(rows).alias("_at", "_kv"))
        return out.select("_kv.key", "_kv.value", *rest, (F.col("seq") * len(pairs) + F.col("_at")).alias("seq"))

    return step


def transform_values(f: Callable[[Column], Column]) -> Step:
    """One row for each element of the array that ``f`` makes of the value, FAN_OUT at most."""

    def step(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in ("value", "seq")]
        made = f(_v())
        many = F.raise_error(F.lit(f"more than {FAN_OUT} values of one row"))
        held = F.when(F.size(made) <= FAN_OUT, made).when(F.size(made) > FAN_OUT, many)
        out = df.select(*rest, "seq", F.posexplode(held).alias("_at", "value"))
        return out.select(*rest, "value", (F.col("seq") * FAN_OUT + F.col("_at")).alias("seq"))

    return step


def python_step(f: Callable[[Iterator[Any]], Iterator[Any]], schema: str | None = None) -> Step:
    """``f`` maps pandas batches with all columns to such batches; ``schema`` where types change."""
    return lambda df: df.mapInPandas(f, schema or df.schema)


@dataclass(frozen=True)
class Pipeline:
    """Steps one after another; with ``keep_key`` the input's key returns at the end, so its partitioning holds."""

    steps: Sequence[Step]
    keep_key: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.keep_key:
            df = df.withColumn("_key", F.col("key"))
        for step in self.steps:
            df = step(df)
        return df.withColumn("key", F.col("_key")).drop("_key") if self.keep_key else df
