"""Assigning rows to time windows; a window's end is exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.relation import millis
from weirflow.plans.model import SessionWindow, TimeWindow


def time_windows(df: DataFrame, window: TimeWindow) -> DataFrame:
    """One row for each window that holds the row; windows that begin before the epoch don't exist."""
    spec = F.window("ts", f"{window.size} milliseconds", f"{window.advance or window.size} milliseconds")
    out = df.select(*df.columns, spec.alias("win"))
    return out.where(F.col("win.start") >= F.timestamp_millis(F.lit(0)))


def sessions(df: DataFrame, keys: list[str], window: SessionWindow) -> DataFrame:
    """Rows with the whole session they end up in: gaps and islands over one sort by key and time."""
    ordered = Window.partitionBy(*keys).orderBy("ts", "seq")
    apart = F.lag("ts").over(ordered)
    starts = df.withColumn("_new", F.when(apart.isNull() | (F.col("ts") > apart + millis(window.gap)), 1).otherwise(0))
    numbered = starts.withColumn("_session", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_session")
    win = F.struct(F.min("ts").over(whole).alias("start"), (F.max("ts").over(whole) + millis(window.gap)).alias("end"))
    return numbered.withColumn("win", win).drop("_new", "_session")


def assigned(df: DataFrame, window: TimeWindow | SessionWindow) -> DataFrame:
    """Rows with the windows of their keys that hold them, in the column win."""
    return sessions(df, ["key"], window) if isinstance(window, SessionWindow) else time_windows(df, window)
