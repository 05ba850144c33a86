"""Streams and tables as DataFrames, and the changes between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """``kind``: stream, table or global.

    ``changelog`` has one row for each event or update; ``snapshot`` the latest row of each key
    (and window), made when asked for, by ``final`` where there is a cheaper plan than picking from the changelog.
    With ``tombstones`` a null value removes its key, so a key whose latest value is null has no row there.
    """

    kind: str
    changelog: DataFrame
    final: Callable[[], DataFrame] | None = None
    store: str | None = None
    tombstones: bool = False

    @property
    def windowed(self) -> bool:
        return "win" in self.changelog.columns

    @property
    def keys(self) -> list[str]:
        return ["key", "win"] if self.windowed else ["key"]

    def snapshot(self) -> DataFrame:
        out = self.final() if self.final else latest(self.changelog, self.keys)
        return out.where(F.col("value").isNotNull()) if self.tombstones else out

    def as_stream(self) -> Relation:
        """The updates as events; a windowed key becomes the plain key."""
        return Relation("stream", self.changelog.drop("win"))

    def as_table(self, store: str | None = None) -> Relation:
        """Latest value per key; a table stays itself unless it gets another store."""
        if self.kind == "stream":
            return Relation("table", self.changelog, store=store, tombstones=True)
        if store is None or store == self.store:
            return self
        return replace(self, store=store)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that is last in ts and seq, by a combinable aggregate (no window, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col("ts"), F.col("seq")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def canonical(df: DataFrame, key: Column | str, value: Column | str, ts: Column | str, seq: Column | str) -> DataFrame:
    """Columns key, value, ts (a timestamp in UTC) and seq of any table."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(key).alias("key"), col(value).alias("value"), col(ts).cast("timestamp").alias("ts"), col(seq).cast("long").alias("seq"))


def millis(n: int) -> Column:
    return F.expr(f"INTERVAL '{n / 1000:.3f}' SECOND")
