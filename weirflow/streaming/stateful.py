"""Operators whose streaming form needs state for each key: one output row for each input row, in order of time.

Each is a processor for transformWithStateInPandas over rows of key, ts, seq and values as JSON text,
so that any value type fits one state schema.  A batch's rows of a key are handled in order of ts and seq.

Spark hands over, and fetches state for, one group at a time, which costs far more than a row.  So keys without timers share
groups: a key's hash gives its bucket, which is the group, and its slot there, one text with the state of some keys.  A
bucket's slots double when they hold more than ``SLOT`` characters on average, so a batch reads and writes the slots of
its keys and nothing that grows with the number of others.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirflow.operators.windows import time_windows
from weirflow.plans.model import Aggregation, SessionWindow, TimeWindow

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXT = T.StructType([T.StructField("v", T.StringType())])


def as_json(df: DataFrame, side: int = 0) -> DataFrame:
    """key as text, side, value as JSON (null stays null), ts and seq."""
    value = F.when(F.col("value").isNotNull(), F.to_json(F.struct(F.col("value").alias("v"))))
    return df.select(F.to_json(F.struct(F.col("key").alias("k"))).alias("k"), F.lit(side).alias("side"), value.alias("j"), F.col("ts").alias("ts"), F.col("seq").alias("seq"))


def _value(text: str | None) -> Any:
    return None if text is None or text is pd.NA or text != text else json.loads(text)["v"]


BUCKETS = 4096  # a checkpoint's state is where this number puts it: another one needs a new checkpoint
SLOT = 8192
_NUMBER = T.StructType([T.StructField("i", T.IntegerType())])
_HEAD = -1  # the slot that holds how often the slots doubled, and the keys and characters in them
_dumps = json.JSONEncoder(separators=(",", ":")).encode
_NEVER = -(10**17)  # a null ts, before all that Spark has; it comes first, as in batch


class _Keyed(StatefulProcessor):
    """State for each key, by buckets of keys; ``step`` maps (state, side, value) to (state, output rows).

    With ``ttl_ms`` the state of a key that gets no row for so long, in processing time, is dropped.
    """

    def __init__(self, step: Callable[[Any, int, Any], tuple[Any, list[Any]]], ttl_ms: int | None = None) -> None:
        self.step, self.ttl_ms, self.slot = step, ttl_ms, SLOT

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", _NUMBER, _TEXT, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        frame = pd.concat(list(rows))
        order = np.lexsort([frame[c].to_numpy() for c in ("seq", "side", "us")])
        columns = [frame[c].to_numpy()[order].tolist() for c in ("k", "side", "j", "us", "seq")]
        depth, n, chars = self._get(_HEAD)[0] or (0, 0, 0)
        held: dict[int, dict[str, list[Any]]] = defaultdict(dict)
        of = {k: self._slot(k, depth) for k in dict.fromkeys(columns[0])}
        for i in set(of.values()) if n else ():
            held[i], had, length = self._read(i)
            n, chars = n - had, chars - length
        states = {k: held[i][k][0] for k, i in of.items() if k in held[i]}
        out: tuple[list, ...] = ([], [], [], [])
        for k, side, text, us, seq in zip(*columns, strict=True):
            states[k], made = self._next(states.get(k), side, text, us, seq)
            for v in made:
                for column, x in zip(out, (k, _dumps({"v": v}), us, seq), strict=True):
                    column.append(x)
        for k, i in of.items():
            if states[k] is not None:
                held[i][k] = [states[k], self.now] if self.ttl_ms else [states[k]]
        self._keep(held, depth, n, chars)
        if out[0]:
            yield pd.DataFrame(dict(zip(("k", "j", "us", "seq"), out, strict=True)))

    def _next(self, state: Any, side: int, text: str | None, us: int, seq: int) -> tuple[Any, list[Any]]:
        return self.step(state, side, _value(text))

    def _slot(self, k: str, depth: int) -> int:
        return zlib.crc32(k.encode()) & (1 << depth) - 1

    def _get(self, i: int) -> tuple[Any, int]:
        """What a slot holds, and its characters."""
        row = self.slots.getValue((i,))
        return (json.loads(row[0]), len(row[0])) if row else (None, 0)

    def _put(self, i: int, text: str) -> None:
        self.slots.updateValue((i,), (text,))

    def _read(self, i: int) -> tuple[dict[str, list[Any]], int, int]:
        """The keys of a slot whose time isn't over, and how many keys and characters it has."""
        found, length = self._get(i)
        found = found or {}
        live = {k: e for k, e in found.items() if e[1] + self.ttl_ms > self.now} if self.ttl_ms else found
        return live, len(found), length

    def _keep(self, held: dict[int, dict[str, list[Any]]], depth: int, n: int, chars: int) -> None:
        """Writes a batch's slots; ``n`` and ``chars`` are what the others have, and all are split where it is too much."""
        texts = {i: _dumps(e) for i, e in held.items()}
        n, chars = n + sum(map(len, held.values())), chars + sum(map(len, texts.values()))
        deeper, limit = depth, self.slot
        if self.ttl_ms and chars > limit << depth and n > 1 << depth:  # whole slots may have gone: count anew
            others = [self._read(i)[1:] for i in range(1 << depth) if i not in held]
            n = sum(map(len, held.values())) + sum(x for x, _ in others)
            chars = sum(map(len, texts.values())) + sum(x for _, x in others)
            limit //= 2  # so that counts which stay near the limit aren't made in each batch
        while chars > limit << deeper and n > 1 << deeper:
            deeper += 1
        for i in range(1 << depth) if deeper > depth else ():
            parts: dict[int, dict[str, list[Any]]] = defaultdict(dict, {i: {}})
            for k, e in (held[i] if i in held else self._read(i)[0]).items():
                parts[self._slot(k, deeper)][k] = e
            texts[i] = _dumps(parts.pop(i))
            for other, part in parts.items():
                self._put(other, _dumps(part))
            self._put(i, texts.pop(i))
        for i, text in texts.items():
            self._put(i, text)
        self._put(_HEAD, _dumps([deeper, n, chars]))

    def close(self) -> None:
        pass


OUT = T.StructType([T.StructField("k", T.StringType()), T.StructField("j", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType())])
MADE = T.StructType([T.StructField("k", T.StringType()), T.StructField("j", T.StringType()), T.StructField("us", T.LongType()), T.StructField("seq", T.LongType())])


def _typed(df: DataFrame, key: T.DataType, value: T.DataType) -> DataFrame:
    """Back from JSON to typed key and value."""
    k = F.from_json("k", T.StructType([T.StructField("k", key)]))["k"]
    v = F.from_json("j", T.StructType([T.StructField("v", value)]))["v"]
    return df.select(k.alias("key"), v.alias("value"), "ts", "seq")


def _with_state(rows: DataFrame, processor: _Keyed, ttl_ms: int | None) -> DataFrame:
    us = F.coalesce(F.unix_micros("ts"), F.lit(_NEVER))
    dealt = rows.select(F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).alias("bucket"), "k", "side", "j", us.alias("us"), "seq")
    out = dealt.groupBy("bucket").transformWithStateInPandas(processor, MADE, "append", "processingTime" if ttl_ms else "none")
    return out.select("k", "j", F.when(F.col("us") != _NEVER, F.timestamp_micros("us")).alias("ts"), "seq")


def keyed(rows: DataFrame, step: Callable[[Any, int, Any], tuple[Any, list[Any]]], key: T.DataType, value: T.DataType, ttl_ms: int | None = None) -> DataFrame:
    """Runs ``step`` over the rows of each key; needs the RocksDB state store."""
    return _typed(_with_state(rows, _Keyed(step, ttl_ms), ttl_ms), key, value)


def running(df: DataFrame, init: Any, add: Callable[[Any, Any], Any], value: T.DataType, ttl_ms: int | None = None) -> DataFrame:
    """A fold's value after each row; rows with a null value are skipped."""

    def step(state: Any, side: int, v: Any) -> tuple[Any, list[Any]]:
        if v is None:
            return state, []
        acc = add(init if state is None else state["a"], v)
        return {"a": acc}, [acc]

    return keyed(as_json(df.where("key is not null")), step, df.schema["key"].dataType, value, ttl_ms)


class Fold:
    """A built-in aggregation as plain Python: a part for each row, parts merge, and have a value."""

    def __init__(self, agg: Aggregation, initial: Any = None) -> None:
        self.kind, self.initial = agg.kind, initial
        self.parts = [(n, Fold(a, (initial or {}).get(n))) for n, a in agg.parts]

    def one(self, x: Any, ms: int, seq: int) -> Any:
        if self.parts:
            return [p.one(x[n], ms, seq) for n, p in self.parts]
        return {"count": 1, "avg": [x, 1], "latest": [ms, seq, x], "collect": [[ms, seq, x]]}.get(self.kind, x)

    def merge(self, a: Any, b: Any) -> Any:
        if self.parts:
            return [p.merge(x, y) for (_, p), x, y in zip(self.parts, a, b, strict=True)]
        if self.kind in ("sum", "count"):
            return a + b
        if self.kind == "avg":
            return [a[0] + b[0], a[1] + b[1]]
        if self.kind == "collect":
            return sorted(a + b, key=lambda e: e[:2])
        return max(a, b, key=lambda e: e[:2]) if self.kind == "latest" else {"min": min, "max": max}[self.kind](a, b)

    def value(self, a: Any) -> Any:
        if self.parts:
            return {n: p.value(x) for (n, p), x in zip(self.parts, a, strict=True)}
        if self.kind == "avg":
            return a[0] / a[1]
        if self.kind == "latest":
            return a[2]
        if self.kind == "collect":
            return [*(self.initial or []), *(e[2] for e in a)]
        if self.initial is None:
            return a
        return {"sum": lambda: a + self.initial, "count": lambda: a + self.initial, "min": lambda: min(a, self.initial), "max": lambda: max(a, self.initial)}[self.kind]()


class _Windows(_Keyed):
    """Windowed aggregates of a key, a row for each row that comes.  ``gap``: sessions, which merge; else a key has one window."""

    def __init__(self, fold: Fold, gap: int | None, ttl_ms: int | None) -> None:
        super().__init__(None, ttl_ms)
        self.fold, self.gap = fold, gap

    def _next(self, state: Any, side: int, text: str | None, us: int, seq: int) -> tuple[Any, list[Any]]:
        ms = us // 1000
        if self.gap is None:
            part = self.fold.one(_value(text), ms, seq)
            held = part if state is None else self.fold.merge(state, part)
            return held, [{"x": self.fold.value(held)}]
        first, last, held, rest = ms, ms, self.fold.one(_value(text), ms, seq), []
        for a, b, other in state or ():
            if a - self.gap <= last and first <= b + self.gap:
                first, last, held = min(first, a), max(last, b), self.fold.merge(other, held)
            else:
                rest.append([a, b, other])
        return [*rest, [first, last, held]], [{"x": self.fold.value(held), "first": first, "last": last}]


def windowed(rows: DataFrame, agg: Aggregation, value: T.DataType, window: TimeWindow | SessionWindow, *, initial: Any = None, ttl_ms: int | None = None) -> DataFrame:
    """A windowed aggregate's value after each row, as key, value, ts, seq and win.

    A session's window is as far as it is known when the row comes.
    """
    gap = window.gap if isinstance(window, SessionWindow) else None
    of = rows if gap is not None else time_windows(rows, window).withColumn("key", F.struct("key", F.unix_millis("win.start").alias("start")))
    out = _with_state(as_json(of), _Windows(Fold(agg, initial), gap, ttl_ms), ttl_ms)
    told = T.StructType([T.StructField("x", value), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    out = _typed(out, of.schema["key"].dataType, told)
    first, end = ("key.start", F.col("key.start") + window.size) if gap is None else ("value.first", F.col("value.last") + gap)
    win = F.struct(F.timestamp_millis(first).alias("start"), F.timestamp_millis(end).alias("end"))
    return out.select("key.key" if gap is None else "key", F.col("value.x").alias("value"), "ts", "seq", win.alias("win"))


def totals(rows: DataFrame, agg: Aggregation, value: T.DataType, *, initial: Any = None, ttl_ms: int | None = None) -> DataFrame:
    """A built-in aggregate's value after each row of a key."""
    out = _with_state(as_json(rows), _Windows(Fold(agg, initial), None, ttl_ms), ttl_ms)
    return _typed(out, rows.schema["key"].dataType, T.StructType([T.StructField("x", value)])).withColumn("value", F.col("value.x"))


class _Limited(StatefulProcessor):
    """Holds a key's last row of a period of ``ms`` until a row of a later one comes or the watermark passes its end."""

    def __init__(self, ms: int) -> None:
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for text, ts, seq in zip(frame["j"], frame["ts"], frame["seq"], strict=True):
            text, us = None if _value(text) is None else text, int(ts.value // 1000)
            if held and us // 1000 // self.ms > held[1] // 1000 // self.ms:
                out.append(held)
            held = [text, us, int(seq)]
        end = (held[1] // 1000 // self.ms + 1) * self.ms
        self.state.update((json.dumps(held),))
        self.handle.registerTimer(end)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        if held and (held[1] // 1000 // self.ms + 1) * self.ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._rows(key, [held])

    def _rows(self, key: Any, held: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], j, pd.Timestamp(us, unit="us"), seq) for j, us, seq in held], columns=["k", "j", "ts", "seq"])

    def close(self) -> None:
        pass


def limited(df: DataFrame, ms: int) -> DataFrame:
    """The last row of each key and period of ``ms``, once the period is over; needs a watermark."""
    with_win = "win" in df.columns
    of = df.withColumn("key", F.struct("key", "win")) if with_win else df
    out = _typed(as_json(of).groupBy("k").transformWithStateInPandas(_Limited(ms), OUT, "append", "eventTime"), of.schema["key"].dataType, df.schema["value"].dataType)
    return out.select("key.key", "value", "ts", "seq", "key.win") if with_win else out


def _pair_type(left: DataFrame, right: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("_1", left.schema["value"].dataType), T.StructField("_2", right.schema["value"].dataType)])


def as_of(stream: DataFrame, table: DataFrame, how: str = "left", ttl_ms: int | None = None) -> DataFrame:
    """Each event with the table's latest value so far; an update of the same time counts."""

    def step(state: Any, side: int, v: Any) -> tuple[Any, list[Any]]:
        if side == 0:  # the table
            return {"r": v}, []
        r = state["r"] if state else None
        return state, [] if how == "inner" and r is None else [{"_1": v, "_2": r}]

    rows = as_json(table, 0).unionByName(as_json(stream, 1))
    return keyed(rows, step, stream.schema["key"].dataType, _pair_type(stream, table), ttl_ms)


def table_table(left: DataFrame, right: DataFrame, how: str, ttl_ms: int | None = None) -> DataFrame:
    """A row for each update of either table with both latest values."""

    def step(state: Any, side: int, v: Any) -> tuple[Any, list[Any]]:
        state = dict(state or {"0": None, "1": None})
        state[str(side)] = v
        a, b = state["0"], state["1"]
        there = {"inner": a is not None and b is not None, "left": a is not None, "outer": a is not None or b is not None}[how]
        return state, [{"_1": a, "_2": b}] if there else []

    rows = as_json(left, 0).unionByName(as_json(right, 1))
    return keyed(rows, step, left.schema["key"].dataType, _pair_type(left, right), ttl_ms)


def replaced(table: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Each update as value (new, old): what a retracting aggregate adds and takes out."""

    def step(state: Any, side: int, v: Any) -> tuple[Any, list[Any]]:
        return {"v": v}, [{"_1": v, "_2": state["v"] if state else None}]

    return keyed(as_json(table), step, table.schema["key"].dataType, _pair_type(table, table), ttl_ms)


class _Eager(StatefulProcessor):
    """Stream-stream join that emits an unmatched row at once.

    Rows are kept within the window of their key's latest time, and at most until the watermark has passed it.
    """

    def __init__(self, before: int, after: int, how: str) -> None:
        self.before, self.after, self.how = before, after, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        kept: list[list[list[Any]]] = json.loads(held[0]) if held else [[], []]
        frame = pd.concat(list(rows)).sort_values(["ts", "side", "seq"], kind="stable")
        out, latest = [], 0
        # rows of one time see each other: put them all in before any looks for partners
        times = [int(t.value // 1_000_000) for t in frame["ts"]]
        entries = [[ms, _value(text), int(seq)] for ms, text, seq in zip(times, frame["j"], frame["seq"], strict=True)]
        sides = [int(s) for s in frame["side"]]
        i = 0
        while i < len(entries):
            j = i
            while j < len(entries) and entries[j][0] == entries[i][0]:
                j += 1
            now = entries[i][0]
            earlier = [list(kept[0]), list(kept[1])]
            for s, e in zip(sides[i:j], entries[i:j], strict=True):
                kept[s].append(e)
            for s, (ms, v, seq) in zip(sides[i:j], entries[i:j], strict=True):
                low, high = (ms - self.before, ms + self.after) if s == 0 else (ms - self.after, ms + self.before)
                partners = [e for e in kept[1 - s] if low <= e[0] <= high]
                for p in partners:
                    if s == 0 or p in earlier[0]:  # a pair of one time goes out once, from the left
                        a, b = (v, p[1]) if s == 0 else (p[1], v)
                        out.append((key[0], json.dumps({"v": {"_1": a, "_2": b}}), pd.Timestamp(max(ms, p[0]), unit="ms"), max(seq, p[2])))
                if not partners and (self.how == "outer" or self.how == "left" and s == 0):
                    out.append((key[0], json.dumps({"v": {"_1": v, "_2": None} if s == 0 else {"_1": None, "_2": v}}), pd.Timestamp(ms, unit="ms"), seq))
            latest, i = now, j
        kept = self._within(kept, latest)
        if kept[0] or kept[1]:
            self.state.update((json.dumps(kept),))
            self.handle.registerTimer(latest + max(self.before, self.after, 0) + 1)
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["k", "j", "ts", "seq"])

    def _within(self, kept: list[list[list[Any]]], now: int) -> list[list[list[Any]]]:
        """The rows of either side that a row at ``now`` or later can still join."""
        return [[e for e in side if e[0] + reach >= now] for side, reach in zip(kept, (self.after, self.before), strict=True)]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            kept = self._within(json.loads(self.state.get()[0]), expiredTimerInfo.getExpiryTimeInMs())
            if kept[0] or kept[1]:
                self.state.update((json.dumps(kept),))
            else:
                self.state.clear()
        yield pd.DataFrame({"k": pd.Series([], dtype=str), "j": pd.Series([], dtype=str), "ts": pd.Series([], dtype="datetime64[ns]"), "seq": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def eager_join(left: DataFrame, right: DataFrame, before: int, after: int, how: str) -> DataFrame:
    """Rows of two streams within a window; unmatched ones (left, outer) as soon as they come."""
    rows = as_json(left, 0).unionByName(as_json(right, 1))
    out = rows.groupBy("k").transformWithStateInPandas(_Eager(before, after, how), OUT, "append", "eventTime")
    return _typed(out, left.schema["key"].dataType, _pair_type(left, right))
