"""The plain data that describes a topology: entities, edges, joins, windows, aggregations.

Rows everywhere have the columns ``key, value, ts, seq`` and, for windowed tables, ``win``
(start and end, the end exclusive).  ``ts`` is event time; ``seq`` breaks ties in it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

KV = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class TimeWindow:
    """Windows of ``size`` ms every ``advance`` ms (tumbling by default), aligned to the epoch.

    ``grace``: how many ms after its end a window still takes late rows.  A batch run takes rows in order of time, so
    none is late; in a stream it is the least delay of the watermark of the sources.
    """

    size: int
    advance: int | None = None
    grace: int = 0

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 < (self.advance or self.size) <= self.size:
            raise ValueError("a window needs a size above 0 and an advance above 0, at most the size")


@dataclass(frozen=True)
class SessionWindow:
    """Sessions that end when ``gap`` ms or more pass without a record; a gap of exactly that still merges.

    ``grace`` as for a TimeWindow.
    """

    gap: int
    grace: int = 0

    def __post_init__(self) -> None:
        if self.gap <= 0:
            raise ValueError("a session needs a gap above 0")


@dataclass(frozen=True)
class JoinWindow:
    """A right record joins from ``before`` ms before the left one to ``after`` ms after it, both included."""

    before: int
    after: int | None = None

    @property
    def upper(self) -> int:
        return self.before if self.after is None else self.after


@dataclass(frozen=True)
class Aggregation:
    """What a table keeps for each group.

    ``kind``: sum, count, min, max, avg, collect, latest, fold, or several.  ``of`` picks the
    number from key and value.  A fold starts from ``init`` and applies ``add(acc, key, value)``
    in order of ts and seq; ``subtract`` takes a replaced row out again.  ``parts``: the names and
    aggregations that one pass keeps side by side, as fields of a struct.
    """

    kind: str
    of: KV | None = None
    init: Any = None
    add: Callable[[Column, Column, Column], Column] | None = None
    subtract: Callable[[Column, Column, Column], Column] | None = None
    parts: tuple[tuple[str, Aggregation], ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("sum", "count", "min", "max", "avg", "collect", "latest", "fold", "several"):
            raise ValueError(f"no aggregation {self.kind!r}")
        if self.kind == "several" and (not self.parts or any(a.kind in ("fold", "several") for _, a in self.parts)):
            raise ValueError("several aggregations need parts, which are no folds")
        if self.kind == "fold" and (self.add is None or self.init is None):
            raise ValueError("a fold needs add and init")


class Agg:
    """Aggregations by name."""

    @staticmethod
    def sum(of: KV | None = None) -> Aggregation:
        return Aggregation("sum", of)

    @staticmethod
    def count() -> Aggregation:
        return Aggregation("count")

    @staticmethod
    def min(of: KV | None = None) -> Aggregation:
        return Aggregation("min", of)

    @staticmethod
    def max(of: KV | None = None) -> Aggregation:
        return Aggregation("max", of)

    @staticmethod
    def avg(of: KV | None = None) -> Aggregation:
        return Aggregation("avg", of)

    @staticmethod
    def collect(of: KV | None = None) -> Aggregation:
        return Aggregation("collect", of)

    @staticmethod
    def latest(of: KV | None = None) -> Aggregation:
        return Aggregation("latest", of)

    @staticmethod
    def fold(init: Any, add: Callable[[Column, Column, Column], Column], subtract: Callable[[Column, Column, Column], Column] | None = None) -> Aggregation:
        """``init`` is a Column or a literal of the accumulator's type."""
        return Aggregation("fold", None, init, add, subtract)

    @staticmethod
    def several(**parts: Aggregation) -> Aggregation:
        """All of ``parts`` in one pass; the value is a struct with a field for each."""
        return Aggregation("several", parts=tuple(parts.items()))


@dataclass(frozen=True)
class Suppress:
    """Holds back updates: ``window_close`` emits a window's last row only, ``time_limit`` batches updates for ``ms``."""

    until: str = "window_close"
    ms: int | None = None

    def __post_init__(self) -> None:
        if self.until not in ("window_close", "time_limit") or self.until == "time_limit" and not self.ms:
            raise ValueError("suppress until window_close, or until time_limit with ms")


@dataclass(frozen=True)
class Topic:
    """A named log that is read where it has no parent and written where it has."""

    name: str
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Stream:
    """Events; ``xform`` is a sequence of stateless steps (see functions.xform)."""

    xform: Sequence[Any] = ()
    keep_key: bool = False


@dataclass(frozen=True)
class Table:
    """The latest value of each key, or an aggregate of each group.

    ``initial`` is what an aggregate starts from: added to a sum or count, compared with a minimum or maximum, put
    before a collection, in the place of a fold's own; a mapping by name for several.  ``store`` names the table's view.
    """

    group_by: KV | None = None
    aggregate: Aggregation | None = None
    window: TimeWindow | SessionWindow | None = None
    suppress: Suppress | None = None
    store: str | None = None
    initial: Any = None


@dataclass(frozen=True)
class GlobalTable:
    """A lookup table of one topic, broadcast if its latest rows are as few, and as small, as this; else Spark picks the join."""

    broadcast_rows: int = 100_000
    broadcast_bytes: int = 32 << 20


Entity = Topic | Stream | Table | GlobalTable


@dataclass(frozen=True)
class Join:
    """How the parents of an entity are joined; ``how``: inner, left, outer, or merge for streams.

    ``eager`` emits an unmatched row as soon as it arrives, as well as the later match.  ``lookup``
    gives the key to look up in a global table.  ``flatten`` makes one struct of all inputs of an n-ary join.
    """

    how: str
    window: JoinWindow | None = None
    lookup: KV | None = None
    eager: bool = False
    flatten: bool = False

    def __post_init__(self) -> None:
        if self.how not in ("inner", "left", "outer", "merge"):
            raise ValueError(f"no join {self.how!r}")


Override = Callable[..., Any]


@dataclass(frozen=True)
class Topology:
    """``workflow``: edges (from, to); ``entities`` by name; ``joins`` by the ordered names of the parents."""

    workflow: Sequence[tuple[str, str]]
    entities: Mapping[str, Entity]
    joins: Mapping[tuple[str, ...], Join] = field(default_factory=dict)
    overrides: Mapping[str, Override] = field(default_factory=dict)

    def validated(self) -> Topology:
        from weirflow.plans.validate import validate

        validate(self)
        return self
