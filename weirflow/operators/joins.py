"""Joins of streams, tables and global tables.

Every join is an equality on the key, so it is one shuffle of each side that
later steps on the key reuse; a time range or an order in time is a residual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.relation import Relation, millis
from weirflow.plans.model import Join, JoinWindow


class JoinError(ValueError):
    """A combination of kinds that has no join."""


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("key").alias(f"{name}_key"), F.col("value").alias(f"{name}_value"), F.col("ts").alias(f"{name}_ts"), F.col("seq").alias(f"{name}_seq"))


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("_1"), right.alias("_2"))


def _in_window(window: JoinWindow) -> Column:
    return F.col("r_ts").between(F.col("l_ts") - millis(window.before), F.col("l_ts") + millis(window.upper))


def _pairs(joined: DataFrame) -> DataFrame:
    """Rows with either side's columns, as canonical rows; a missing side is null in the pair."""
    return joined.select(
        F.coalesce("l_key", "r_key").alias("key"),
        _pair(F.col("l_value"), F.col("r_value")).alias("value"),
        F.greatest("l_ts", "r_ts").alias("ts"),
        F.greatest("l_seq", "r_seq").alias("seq"),
    )


def sliced(l: DataFrame, r: DataFrame, window: JoinWindow) -> tuple[DataFrame, DataFrame]:
    """Both sides with a slice of time beside the key, so that a hot key spreads over tasks.

    Slices are as long as the window; a left row goes to its own slice and to those its window reaches.
    """
    width = max(window.before + window.upper, 1)
    slot = lambda c: F.floor(F.unix_millis(c) / width)
    left = l.withColumn("slice", F.explode(F.sequence(slot(F.col("l_ts") - millis(window.before)), slot(F.col("l_ts") + millis(window.upper)))))
    return left, r.withColumn("slice", slot(F.col("r_ts")))


def stream_stream(left: DataFrame, right: DataFrame, join: Join, *, slices: bool = False) -> DataFrame:
    """Rows of two streams whose times are within the window; ``slices`` spreads hot keys of an inner join."""
    l, r = _side(left, "l"), _side(right, "r")
    near = (F.col("l_key") == F.col("r_key")) & _in_window(join.window)
    if slices and join.how == "inner":
        a, b = sliced(l, r, join.window)
        return _pairs(a.join(b.withColumnRenamed("slice", "r_slice"), near & (F.col("slice") == F.col("r_slice"))))
    if not join.eager or join.how == "inner":
        return _pairs(l.join(r, near, {"inner": "inner", "left": "left", "outer": "full_outer"}[join.how]))
    # an unmatched row goes out at once unless a partner has come already; a tie counts as come
    out = _pairs(l.join(r, near))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    came_right = (F.col("l_key") == F.col("r_key")) & F.col("r_ts").between(F.col("l_ts") - millis(join.window.before), F.least(F.col("l_ts"), F.col("l_ts") + millis(join.window.upper)))
    alone = l.join(r, came_right, "left_anti").withColumns({"r_key": none(l, "l_key"), "r_value": none(r, "r_value"), "r_ts": none(r, "r_ts"), "r_seq": none(r, "r_seq")})
    out = out.unionByName(_pairs(alone))
    if join.how == "outer":
        came_left = (F.col("l_key") == F.col("r_key")) & F.col("l_ts").between(F.col("r_ts") - millis(join.window.upper), F.least(F.col("r_ts"), F.col("r_ts") + millis(join.window.before)))
        alone = r.join(l, came_left, "left_anti").withColumns({"l_key": none(r, "r_key"), "l_value": none(l, "l_value"), "l_ts": none(l, "l_ts"), "l_seq": none(l, "l_seq")})
        out = out.unionByName(_pairs(alone))
    return out


def _both(left: DataFrame, right: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of both sides in one frame: side 0 or 1 and either's value in a struct that is null for the other."""
    keep = ["key", *extra, "ts", "seq"]
    held = F.struct(F.col("value").alias("v"))
    kinds = [df.select(held.alias("v")).schema[0].dataType for df in (left, right)]
    a = left.select(*keep, F.lit(0).alias("side"), held.alias("l"), F.lit(None).cast(kinds[1]).alias("r"))
    b = right.select(*keep, F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("l"), held.alias("r"))
    return a.unionByName(b)


def table_table_changes(left: Relation, right: Relation, how: str) -> DataFrame:
    """One row for each update of either table, with the latest value of both; an equality join of histories
    by one shuffle and a running window, without a product of updates."""
    keys = left.keys
    both = _both(left.changelog, right.changelog, keys[1:])
    so_far = Window.partitionBy(*keys).orderBy("ts", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({"l": F.last("l", ignorenulls=True).over(so_far), "r": F.last("r", ignorenulls=True).over(so_far)})
    # a null value of a known key is a deletion, as a key that never came
    rows = rows.select(*keys, "ts", "seq", F.col("l.v").alias("a"), F.col("r.v").alias("b"))
    need = {"inner": F.col("a").isNotNull() & F.col("b").isNotNull(), "left": F.col("a").isNotNull(), "outer": F.col("a").isNotNull() | F.col("b").isNotNull()}[how]
    return rows.where(need).select("key", _pair(F.col("a"), F.col("b")).alias("value"), "ts", "seq", *keys[1:])


def table_table_snapshot(left: Relation, right: Relation, how: str) -> DataFrame:
    """The joined latest rows of both tables."""
    keys = left.keys
    a = left.snapshot().where("value is not null").select(*keys, F.col("value").alias("a"), F.col("ts").alias("a_ts"), F.col("seq").alias("a_seq"))
    b = right.snapshot().where("value is not null").select(*keys, F.col("value").alias("b"), F.col("ts").alias("b_ts"), F.col("seq").alias("b_seq"))
    joined = a.join(b, keys, {"inner": "inner", "left": "left", "outer": "full_outer"}[how])
    return joined.select("key", _pair(F.col("a"), F.col("b")).alias("value"), F.greatest("a_ts", "b_ts").alias("ts"), F.greatest("a_seq", "b_seq").alias("seq"), *keys[1:])


def as_of(stream: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Each event with the table's latest value at its time (an update of the same time counts)."""
    both = _both(stream, table, [])
    so_far = Window.partitionBy("key").orderBy("ts", F.desc("side"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("r", F.last("r", ignorenulls=True).over(so_far)).where("side = 0")
    if how == "inner":
        rows = rows.where(F.col("r.v").isNotNull())
    return rows.select("key", _pair(F.col("l.v"), F.col("r.v")).alias("value"), "ts", "seq")


def lookup(stream: DataFrame, table: Relation, join: Join, small: bool) -> DataFrame:
    """Events with a global table's value for their key or ``join.lookup``; the event's key stays."""
    by = join.lookup or (lambda k, v: k)
    g = table.snapshot().where("value is not null").select(F.col("key").alias("g_key"), F.col("value").alias("g_value"))
    s = stream.withColumn("_by", by(F.col("key"), F.col("value")))
    joined = s.join(F.broadcast(g) if small else g, F.col("_by") == F.col("g_key"), join.how)
    return joined.select("key", _pair(F.col("value"), F.col("g_value")).alias("value"), "ts", "seq")


def merge(relations: list[Relation]) -> Relation:
    return Relation("stream", reduce(DataFrame.unionByName, (r.as_stream().changelog for r in relations)))


def _two(left: Relation, right: Relation, join: Join, small: bool) -> Relation:
    kinds = (left.kind, right.kind)
    if join.how == "merge":
        return merge([left, right])
    if kinds == ("stream", "stream"):
        return Relation("stream", stream_stream(left.changelog, right.changelog, join))
    if kinds == ("table", "table"):
        if left.windowed != right.windowed:
            raise JoinError("a windowed table joins only a windowed table")
        return Relation("table", table_table_changes(left, right, join.how), final=lambda: table_table_snapshot(left, right, join.how))
    if kinds == ("stream", "table") and join.how in ("inner", "left"):
        return Relation("stream", as_of(left.changelog, right.changelog.drop("win"), join.how))
    if kinds == ("stream", "global") and join.how in ("inner", "left"):
        return Relation("stream", lookup(left.changelog, right, join, small))
    raise JoinError(f"no {join.how} join of {kinds[0]} and {kinds[1]}")


def _reshaped(relation: Relation, value: Column) -> Relation:
    again = lambda df: df.withColumn("value", value)
    return Relation(relation.kind, again(relation.changelog), final=(lambda: again(relation.snapshot())) if relation.final else None)


class Nesting:
    """The shape of the value while inputs are joined one after another: two inputs (a, b), three (a, b, c), four
    ((a, b, c), d), five ((a, b, c), d, e) and so on; with ``flatten`` one struct of all."""

    def __init__(self, join: Join) -> None:
        self.join, self.width, self.flat = join, 2, 2

    def after(self) -> Column | None:
        """The value's new shape after one more input, if the pair that the join made isn't that already."""
        if self.join.how == "merge":
            return None
        shape = None
        if self.join.flatten or self.width == 2:
            count, inner = self.flat if self.join.flatten else 2, F.col("value._1")
            shape = F.struct(*(inner[f"_{i}"].alias(f"_{i}") for i in range(1, count + 1)), F.col("value._2").alias(f"_{count + 1}"))
            self.width = 3
        else:
            self.width = 2
        self.flat += 1
        return shape


def join_all(relations: list[Relation], join: Join, small: bool = True) -> Relation:
    """A left fold over the relations, with values as Nesting has them.  A missing input is null in its place."""
    if len(relations) == 1:
        return relations[0]
    out, nesting = _two(relations[0], relations[1], join, small), Nesting(join)
    for right in relations[2:]:
        out = _two(out, right, join, small)
        shape = nesting.after()
        out = out if shape is None else _reshaped(out, shape)
    return out
