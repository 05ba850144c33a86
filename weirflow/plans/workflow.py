"""Reusable fragments of topologies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.relation import Relation
from weirflow.plans.model import Entity, Stream, Table


def first_of_each(df: DataFrame, of: Callable[[Column], Column] | None = None, *, within_watermark: bool = False) -> DataFrame:
    """The first row, in order of ts and seq, of each key and value, or of each key and ``of(value)``.

    A stream keeps every key and id; ``within_watermark`` keeps one only as long as the watermark's delay, so a
    duplicate that comes later goes out again.
    """
    ident = of(F.col("value")) if of else F.col("value")
    rows = df.withColumn("_id", ident)
    if df.isStreaming:
        return (rows.dropDuplicatesWithinWatermark if within_watermark else rows.dropDuplicates)(["key", "_id"]).drop("_id")
    rest = [c for c in df.columns if c != "key"]
    first = rows.groupBy("key", "_id").agg(F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("_first"))
    return first.select("key", "_first.*").select(*df.columns)


def dedupe_entities(name: str, of: Callable[[Column], Column] | None = None, *, within_watermark: bool = False) -> tuple[dict[str, Entity], dict[str, Callable]]:
    """A fragment's entities and their overrides: a table of the first row of each key and value, or id of the value,
    and the stream of its updates."""

    def known(entity: Entity, parents: list[Relation], made: dict[str, Relation]) -> Relation:
        first = first_of_each(parents[0].as_stream().changelog, of, within_watermark=within_watermark)
        return Relation("table", first)

    return {f"dedupe/{name}-table": Table(), f"dedupe/{name}-stream": Stream()}, {f"dedupe/{name}-table": known}


def with_dedupe(name: str, source: str, target: str) -> list[tuple[str, str]]:
    """The edges that put the fragment between two entities."""
    table, stream = f"dedupe/{name}-table", f"dedupe/{name}-stream"
    return [(source, table), (table, stream), (stream, target)]
