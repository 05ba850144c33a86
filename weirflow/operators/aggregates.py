"""Aggregating tables: running values as a changelog, combinable aggregates as a snapshot."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weirflow.operators.relation import Relation
from weirflow.operators.windows import assigned
from weirflow.plans.model import Aggregation, Suppress, Table

#: Kinds from which a replaced row can be taken out again without keeping all rows.
SIGNED = ("sum", "count", "avg")


def signed(agg: Aggregation) -> bool:
    return agg.kind in SIGNED or agg.kind == "fold" and agg.subtract is not None or agg.kind == "several" and all(signed(a) for _, a in agg.parts)


def numbers(agg: Aggregation) -> Column:
    """What is aggregated of a row with the columns _k and value; a field for each of several."""
    if agg.kind == "several":
        return F.struct(*(numbers(a).alias(n) for n, a in agg.parts))
    if agg.kind in ("count", "fold"):
        return F.lit(1)
    return agg.of(F.col("_k"), F.col("value")) if agg.of else F.col("value")


def _lit(x: Any) -> Column:
    return x if isinstance(x, Column) else F.array(*map(F.lit, x)) if isinstance(x, list | tuple) else F.lit(x)


def begun(agg: Aggregation, initial: Any, value: Column) -> Column:
    """The value of an aggregate that starts from ``initial``; a fold starts from it by itself."""
    if agg.kind == "several" and initial:
        return F.struct(*(begun(a, initial.get(n), value[n]).alias(n) for n, a in agg.parts))
    if initial is None or agg.kind == "fold":
        return value
    return {"sum": lambda: value + _lit(initial), "count": lambda: value + _lit(initial), "min": lambda: F.least(value, _lit(initial)), "max": lambda: F.greatest(value, _lit(initial)), "collect": lambda: F.concat(_lit(initial), value)}[agg.kind]()


def plain(agg: Aggregation, x: Column | None = None) -> Column:
    """The aggregate of the column _x over signs _sign (1 or -1), for SIGNED kinds, or over all rows."""
    x, sign = F.col("_x") if x is None else x, F.col("_sign")
    order = F.struct("ts", "seq", "_sign")
    if agg.kind == "several":
        return F.struct(*(plain(a, x[n]).alias(n) for n, a in agg.parts))
    if agg.kind == "latest":
        return F.max_by(x, order)
    if agg.kind == "collect":
        return F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "_sign", x.alias("x")))), lambda e: e["x"])
    return {
        "sum": lambda: F.sum(x * sign),
        "count": lambda: F.sum(sign.cast("long")),
        "avg": lambda: F.try_divide(F.sum(x * sign), F.sum(sign.cast("long"))),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
    }[agg.kind]()


def folded(agg: Aggregation, rows: Column) -> Column:
    init = agg.init if isinstance(agg.init, Column) else F.lit(agg.init)

    def step(acc: Column, e: Column) -> Column:
        added = agg.add(acc, e["k"], e["v"])
        return F.when(e["sign"] > 0, added).otherwise(agg.subtract(acc, e["k"], e["v"])) if agg.subtract else added

    return F.aggregate(F.array_sort(rows), init, step)


def fold_rows() -> Column:
    return F.collect_list(F.struct(F.col("ts").alias("ts"), F.col("seq").alias("seq"), F.col("_sign").alias("sign"), F.col("_k").alias("k"), F.col("value").alias("v")))


def _so_far(agg: Aggregation, x: Column, so_far: Window) -> Column:
    if agg.kind == "several":
        return F.struct(*(_so_far(a, x[n], so_far).alias(n) for n, a in agg.parts))
    if agg.kind == "latest":
        return x
    if agg.kind == "collect":
        return F.collect_list(x).over(so_far)
    if agg.kind == "avg":
        return F.try_divide(F.sum(x * F.col("_sign")).over(so_far), F.sum(F.col("_sign").cast("long")).over(so_far))
    return plain(agg, x).over(so_far)


def _running(rows: DataFrame, keys: list[str], agg: Aggregation, initial: Any) -> DataFrame:
    """One row for each input row with the aggregate so far.  A fold's value is folded anew from each prefix of a group."""
    so_far = Window.partitionBy(*keys).orderBy("ts", "seq", "_sign").rowsBetween(Window.unboundedPreceding, 0)
    value = folded(agg, fold_rows().over(so_far)) if agg.kind == "fold" else _so_far(agg, F.col("_x"), so_far)
    return rows.withColumn("value", value).withColumn("value", begun(agg, initial, F.col("value"))).select("key", "value", "ts", "seq", *keys[1:])


def _total(rows: DataFrame, keys: list[str], agg: Aggregation, initial: Any) -> DataFrame:
    """One row for each group: partial aggregates before the shuffle where the kind has them."""
    last = F.max(F.struct("ts", "seq")).alias("_last")
    value = folded(agg, F.col("_rows")) if agg.kind == "fold" else begun(agg, initial, F.col("_value"))
    held = fold_rows().alias("_rows") if agg.kind == "fold" else plain(agg).alias("_value")
    out = rows.groupBy(*keys).agg(held, last).select("key", value.alias("value"), "_last.ts", "_last.seq", *keys[1:])
    return out.where("value is not null") if agg.kind == "avg" else out  # the average of none is a removal


class _Live:
    """An aggregate over the rows that are in a group at a time: ``put`` and ``take`` by the row's key."""

    def __init__(self, agg: Aggregation) -> None:
        self.kind, self.rows, self.heap, self.count = agg.kind, {}, [], 0
        self.parts = [(n, _Live(a)) for n, a in agg.parts]
        self.sum = 0

    def put(self, member: str, x: Any) -> None:
        for n, p in self.parts:
            p.put(member, x[n])
        self.count += 1
        self.rows[member] = (self.count, x)
        if x is not None and self.kind in ("min", "max"):
            heapq.heappush(self.heap, (x if self.kind == "min" else _Reversed(x), self.count, member))
        elif x is not None and self.kind in ("sum", "avg"):
            self.sum += x

    def take(self, member: str) -> None:
        for _, p in self.parts:
            p.take(member)
        _, x = self.rows.pop(member)
        if x is not None and self.kind in ("sum", "avg"):
            self.sum -= x

    def value(self) -> Any:
        if self.kind == "several":
            return {n: p.value() for n, p in self.parts}
        if self.kind in ("min", "max"):
            while self.heap and self.rows.get(self.heap[0][2], (0,))[0] != self.heap[0][1]:
                heapq.heappop(self.heap)
            top = self.heap[0][0] if self.heap else None
            return top.x if isinstance(top, _Reversed) else top
        if self.kind == "latest":
            return next(reversed(self.rows.values()))[1] if self.rows else None
        if self.kind == "collect":
            return [x for _, x in self.rows.values() if x is not None]
        if self.kind == "avg":
            return self.sum / len(self.rows) if self.rows else None
        return self.sum if self.kind == "sum" else len(self.rows)


class _Reversed:
    """Sorts the other way round."""

    def __init__(self, x: Any) -> None:
        self.x = x

    def __lt__(self, other: _Reversed) -> bool:
        return other.x < self.x

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and other.x == self.x


def type_of(agg: Aggregation, x: T.DataType) -> T.DataType:
    if agg.kind == "several":
        return T.StructType([T.StructField(n, type_of(a, x[n].dataType)) for n, a in agg.parts])
    if agg.kind == "sum":
        return T.LongType() if isinstance(x, T.IntegralType) else T.DoubleType()
    return {"collect": T.ArrayType(x), "avg": T.DoubleType(), "count": T.LongType()}.get(agg.kind, x)


def _changes(rows: DataFrame, agg: Aggregation) -> DataFrame:
    """One row for each row that comes to or leaves a group, with the aggregate of those that are in it.

    Each task scans its groups in order of time and holds the rows that are in the group at hand.
    """
    kind = type_of(agg, rows.schema["_x"].dataType)
    of = to_arrow_type(kind)
    ordered = rows.repartition("key").sortWithinPartitions("key", "ts", "seq", "_sign")
    text = lambda c: F.to_json(F.struct(c))
    schema = T.StructType([rows.schema["key"], T.StructField("value", kind), rows.schema["ts"], rows.schema["seq"]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, live = None, _Live(agg)
        for batch in batches:
            out = []
            for g, member, sign, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != group:
                    group, live = g, _Live(agg)
                if sign > 0:
                    live.put(member, x)
                else:
                    live.take(member)
                out.append(live.value())
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(out, of), batch.column(5), batch.column(6)], names=schema.names)

    return ordered.select(text("key").alias("g"), text("_k").alias("m"), "_sign", "_x", "key", "ts", "seq").mapInArrow(scan, schema)


def deltas(changelog: DataFrame, key_columns: list[str], group) -> DataFrame:
    """Each update of a table as a row taken from its old group (sign -1) and one added to its new group (sign 1)."""
    history = Window.partitionBy(*key_columns).orderBy("ts", "seq")
    rows = changelog.withColumn("_k", F.col("key")).withColumn("_old", F.lag(F.struct("value")).over(history))
    new = rows.where("value is not null").select("_k", "value", "ts", "seq", F.lit(1).alias("_sign"))
    old = rows.where("_old.value is not null").select("_k", F.col("_old.value").alias("value"), "ts", "seq", F.lit(-1).alias("_sign"))
    both = new.unionByName(old)
    return both.withColumn("key", group(F.col("_k"), F.col("value")))


def aggregate(parent: Relation, table: Table) -> Relation:
    """The table's changelog and snapshot.

    A stream parent, or a table's updates when there is a window, adds every row; a plain table parent adds each
    new value and takes out the one it replaces.  Null keys, values and groups are skipped.
    """
    agg, group = table.aggregate, table.group_by
    if agg.kind == "fold" and table.initial is not None:
        agg = replace(agg, init=table.initial)
    retract = parent.kind == "table" and table.window is None
    if retract:
        if agg.kind == "fold" and not agg.subtract:
            raise ValueError("a fold over a table needs subtract")
        rows = deltas(parent.changelog, parent.keys, group)
    else:
        rows = parent.as_stream().changelog.withColumn("_k", F.col("key")).withColumn("_sign", F.lit(1))
        rows = rows.where("key is not null and value is not null").withColumn("key", group(F.col("_k"), F.col("value")))
    rows = rows.where("key is not null").withColumn("_x", numbers(agg))
    keys = ["key"]
    if table.window is not None:
        rows, keys = assigned(rows, table.window), ["key", "win"]
    if retract and not signed(agg):
        changes = _changes(rows, agg)
        changes = changes.withColumn("value", begun(agg, table.initial, F.col("value")))
        return Relation("table", changes, final=lambda: _from_snapshot(parent, table), store=table.store)
    return Relation("table", _running(rows, keys, agg, table.initial), final=lambda: _total(rows, keys, agg, table.initial), store=table.store)


def _from_snapshot(parent: Relation, table: Table) -> DataFrame:
    """Aggregates that can't take a row out again, of the parent's latest rows only; a group that lost its last row is none."""
    rows = parent.snapshot().where("value is not null").withColumn("_k", F.col("key")).withColumn("_sign", F.lit(1))
    rows = rows.withColumn("key", table.group_by(F.col("_k"), F.col("value"))).where("key is not null")
    return _total(rows.withColumn("_x", numbers(table.aggregate)), ["key"], table.aggregate, table.initial)


def suppress(relation: Relation, how: Suppress) -> Relation:
    """Until a window closes: its last row only.  Until a time limit: the last row of each key and period of it."""
    if how.until == "window_close":
        return Relation("table", relation.snapshot(), final=relation.snapshot, store=relation.store)
    period = F.floor(F.unix_millis("ts") / how.ms)
    rows = relation.changelog.withColumn("_period", period)
    last = rows.groupBy(*relation.keys, "_period").agg(F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", "seq")).alias("_last"))
    return Relation("table", last.select("key", "_last.*", *relation.keys[1:]), final=relation.final, store=relation.store)
