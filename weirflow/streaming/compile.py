"""The streaming compiler: a topology as Structured Streaming queries, one for each sink.

What Spark streams natively stays native: stateless steps, unions, windowed aggregates,
stream-stream joins under a watermark, lookups in a static table, deduplication.  The rest
(tables joined with tables, as-of joins, eager outer joins, running and retracting aggregates,
windows that emit each update) runs as keyed state.  Ordering across batches is arrival order; late rows within a batch are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weirflow.functions.xform import Pipeline
from weirflow.operators.aggregates import begun, fold_rows, folded, numbers, plain, type_of
from weirflow.operators.joins import JoinError, Nesting, lookup, stream_stream
from weirflow.operators.relation import Relation, latest
from weirflow.operators.windows import time_windows
from weirflow.plans import graph
from weirflow.plans.batch import small
from weirflow.plans.model import GlobalTable, Join, SessionWindow, Stream, Table, Topic, Topology
from weirflow.sources.io import encoded
from weirflow.streaming import stateful


@dataclass(frozen=True)
class StreamTable:
    """How a table without a window folds in a stream: plain Python over decoded values."""

    init: Any
    add: Callable[[Any, Any], Any]
    type: T.DataType
    subtract: Callable[[Any, Any], Any] | None = None


class _Ended(StreamingQueryListener):
    """Tells ``on_error`` the name and the message of each of its queries that fails."""

    def __init__(self, on_error: Callable[[str, str], None]) -> None:
        self.on_error, self.names = on_error, {}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception and str(event.runId) in self.names:
            self.on_error(self.names[str(event.runId)], event.exception)


@contextmanager
def _without_empty_batches(spark: SparkSession, off: bool) -> Iterator[None]:
    """State that goes with time asks for batches without rows for ever; a query that ends must do without them."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    if off:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Plan:
    """Streaming frames by entity; ``start`` writes the topics that have parents."""

    topology: Topology
    frames: dict[str, DataFrame]
    folder: str | None = None
    ttl_ms: int | None = None
    queries: list[StreamingQuery] = field(default_factory=list)
    listener: _Ended | None = None

    def sinks(self) -> dict[str, DataFrame]:
        """What is written to each topic, in the order of the workflow."""
        edges = self.topology.workflow
        return {self.topology.entities[n].name: self.frames[n] for n in graph.order(edges) if isinstance(self.topology.entities[n], Topic) and graph.parents(edges, n)}

    def start(self, folder: str | None = None, checkpoints: str | None = None, *, once: bool = False, kafka: str | None = None, on_error: Callable[[str, str], None] | None = None) -> list[StreamingQuery]:
        """One query for each sink topic; ``once`` handles what is there and ends, a topic before those that read it.

        Topics are Parquet folders below ``folder`` (by default the one that topics between are kept in), or with
        ``kafka`` (servers) Kafka topics of encoded rows.  ``on_error`` is called with the name and message of a
        query that fails.
        """
        folder = folder or self.folder
        for name, df in self.sinks().items():
            spark = df.sparkSession
            if on_error and self.listener is None:
                self.listener = _Ended(on_error)
                spark.streams.addListener(self.listener)
            writer = (encoded(df).writeStream.format("kafka").option("kafka.bootstrap.servers", kafka).option("topic", name) if kafka else df.writeStream.format("parquet").option("path", f"{folder}/{name}")).queryName(name.replace("-", "_")).option("checkpointLocation", f"{checkpoints}/{name}").outputMode("append")
            with _without_empty_batches(spark, once and bool(self.ttl_ms)):
                query = (writer.trigger(availableNow=True) if once else writer).start()
            if self.listener:
                self.listener.names[str(query.runId)] = name
            self.queries.append(query)
            if once and self.folder and graph.children(self.topology.workflow, _entity_of(self.topology, name)):
                query.awaitTermination()
        return self.queries

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        if self.listener:
            self.frames[next(iter(self.frames))].sparkSession.streams.removeListener(self.listener)
            self.listener = None

    def await_all(self) -> None:
        """Waits for all queries; raises the first failure."""
        for q in self.queries:
            q.awaitTermination()
            if q.exception():
                raise q.exception()


def _entity_of(topology: Topology, topic: str) -> str:
    return next(n for n, e in topology.entities.items() if isinstance(e, Topic) and e.name == topic)


def _numbered(df: DataFrame, table: Table) -> DataFrame:
    rows = df.where("key is not null and value is not null").withColumn("_k", F.col("key")).withColumn("_sign", F.lit(1))
    rows = rows.withColumn("_x", numbers(table.aggregate)).withColumn("key", table.group_by(F.col("_k"), F.col("value")))
    return rows.where("key is not null")


def _closed(df: DataFrame, table: Table) -> DataFrame:
    """A windowed aggregate in append mode: each window's last row, once the watermark has passed it."""
    agg, w = table.aggregate, table.window
    if agg.kind == "fold" and table.initial is not None:
        agg = replace(agg, init=table.initial)
    by = F.session_window("ts", f"{w.gap} milliseconds") if isinstance(w, SessionWindow) else F.window("ts", f"{w.size} milliseconds", f"{w.advance or w.size} milliseconds")
    held = fold_rows() if agg.kind == "fold" else plain(agg)
    out = _numbered(df, table).groupBy("key", by.alias("win")).agg(held.alias("held"), F.max("seq").alias("seq"))
    out = out.where(F.col("win.start") >= F.timestamp_millis(F.lit(0)))  # as in batch, windows begin with the epoch
    value = folded(agg, F.col("held")) if agg.kind == "fold" else begun(agg, table.initial, F.col("held"))
    return out.select("key", value.alias("value"), (F.col("win.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("ts"), "seq", "win")


def _each(name: str, df: DataFrame, table: Table, tables: Mapping[str, StreamTable], ttl_ms: int | None) -> DataFrame:
    """A windowed aggregate's value after each row."""
    rows, agg, w = _numbered(df, table), table.aggregate, table.window
    if agg.kind == "fold":
        fold = tables.get(name)
        if fold is None or isinstance(w, SessionWindow):
            raise KeyError(f"{name}: a fold that emits each update of a window needs a StreamTable, and windows that don't merge; suppressed until they close it needs neither")
        rows = time_windows(rows, w).select(F.struct("key", "win").alias("key"), "value", "ts", "seq")
        return stateful.running(rows, fold.init, fold.add, fold.type, ttl_ms).select("key.key", "value", "ts", "seq", "key.win")
    kind = type_of(agg, rows.schema["_x"].dataType)
    rows = rows.withColumn("value", F.col("_x")).select("key", "value", "ts", "seq")
    return stateful.windowed(rows, agg, kind, w, initial=table.initial, ttl_ms=ttl_ms)


def _two(left: tuple[str, DataFrame], right: tuple[str, DataFrame], join: Join, fits: bool, ttl_ms: int | None) -> tuple[str, DataFrame]:
    (a, l), (b, r) = left, right
    if join.how == "merge":
        return "stream", l.unionByName(r)
    if (a, b) == ("stream", "stream"):
        if join.eager:
            return "stream", stateful.eager_join(l, r, join.window.before, join.window.upper, join.how)
        return "stream", stream_stream(l, r, join)
    if (a, b) == ("stream", "table"):
        return "stream", stateful.as_of(l, r, join.how, ttl_ms)
    if (a, b) == ("table", "table"):
        return "table", stateful.table_table(l, r, join.how, ttl_ms)
    if (a, b) == ("stream", "global"):
        return "stream", lookup(l, Relation("global", r), join, fits)
    raise JoinError(f"no streaming {join.how} join of {a} and {b}")


def _late_enough(topology: Topology, sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The sources with a watermark that lets rows be as late as the longest grace of a window; one that they have must do."""
    grace = max([0, *(e.window.grace for e in topology.entities.values() if isinstance(e, Table) and e.window)])
    out = {}
    for name, df in sources.items():
        delay = df.schema["ts"].metadata.get("spark.watermarkDelayMs") if df.isStreaming else None
        if delay is not None and int(delay) < grace:
            raise ValueError(f"{name}: its watermark is {delay} ms late, and a window has a grace of {grace} ms")
        out[name] = df.withWatermark("ts", f"{grace} milliseconds") if df.isStreaming and delay is None else df
    return out


def _between(df: DataFrame, folder: str, name: str) -> DataFrame:
    """What other queries read of a topic that one query writes: rows go through storage."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    bare = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    spark.createDataFrame([], bare).write.mode("append").parquet(path)
    delay = df.schema["ts"].metadata.get("spark.watermarkDelayMs", 0)
    return spark.readStream.schema(bare).parquet(path).withWatermark("ts", f"{delay} milliseconds")


def compile_streams(topology: Topology, sources: Mapping[str, DataFrame], tables: Mapping[str, StreamTable] | None = None, *, folder: str | None = None, ttl_ms: int | None = None) -> Plan:
    """Streaming frames for every entity over streaming (or, for global tables, static) sources.

    ``tables`` gives the Python folds of tables that emit each update of an aggregate, where it is a fold or has no
    window.  With ``folder`` a topic between entities is a boundary: its query writes it there, and other queries read
    it from there.  ``ttl_ms``: how long, in processing time, keyed state without a window outlives its last row.
    """
    topology.validated()
    sources = _late_enough(topology, sources)
    made: dict[str, tuple[str, DataFrame]] = {}
    frames: dict[str, DataFrame] = {}
    for name in graph.order(topology.workflow):
        entity, own = topology.entities[name], graph.parents(topology.workflow, name)
        if name in topology.overrides:
            out = topology.overrides[name](entity, [Relation(*made[p]) for p in own], {n: Relation(*m) for n, m in made.items()})
            made[name] = (out.kind, out.changelog) if isinstance(out, Relation) else ("stream", out)
            continue
        if not own:
            made[name] = ("stream", sources[name])
            continue
        parents = [made[p] for p in own]
        found = graph.join_of(topology, name) if len(own) > 1 else None
        if isinstance(entity, Topic) or len(own) > 1 and not found:
            df = parents[0][1].drop("win")
            for _, other in parents[1:]:
                df = df.unionByName(other.drop("win"))
            kind = "stream"
        elif found:
            names, join = found
            (kind, df), nesting = made[names[0]], Nesting(join)
            for i, n in enumerate(names[1:]):
                fits = isinstance(topology.entities[n], GlobalTable) and not made[n][1].isStreaming and small(latest(made[n][1], ["key"]), topology.entities[n])
                kind, df = _two((kind, df), made[n], join, fits, ttl_ms)
                shape = nesting.after() if i else None
                df = df if shape is None else df.withColumn("value", shape)
        else:
            kind, df = parents[0]
        if isinstance(entity, GlobalTable):
            made[name] = ("global", df)
        elif isinstance(entity, Stream):
            made[name] = ("stream", Pipeline(entity.xform, entity.keep_key)(df.drop("win")))
        elif isinstance(entity, Table):
            if entity.aggregate is None:
                made[name] = ("table", df)
            elif entity.window is not None:
                closed = entity.suppress is not None and entity.suppress.until == "window_close"
                made[name] = ("table", _closed(df, entity) if closed else _each(name, df, entity, tables or {}, ttl_ms))
            else:
                made[name] = ("table", _running(name, df, kind, entity, tables or {}, ttl_ms))
            if entity.suppress is not None and entity.suppress.until == "time_limit":
                made[name] = ("table", stateful.limited(made[name][1], entity.suppress.ms))
        else:
            frames[name] = df
            between = folder and isinstance(entity, Topic) and graph.children(topology.workflow, name)
            made[name] = (kind, _between(df, folder, entity.name) if between else df)
    return Plan(topology, {n: frames.get(n, df) for n, (_, df) in made.items()}, folder, ttl_ms)


def _running(name: str, df: DataFrame, kind: str, table: Table, tables: Mapping[str, StreamTable], ttl_ms: int | None) -> DataFrame:
    """A table's value after each row; over a table each update leaves its old group first."""
    fold = tables.get(name)
    if fold is None and kind == "stream" and table.aggregate.kind != "fold":
        rows = _numbered(df, table).withColumn("value", F.col("_x"))
        return stateful.totals(rows.select("key", "value", "ts", "seq"), table.aggregate, type_of(table.aggregate, rows.schema["_x"].dataType), initial=table.initial, ttl_ms=ttl_ms)
    if fold is None:
        raise KeyError(f"{name}: a fold, and an aggregate of a table, need a StreamTable to fold by in a stream")
    init = fold.init if table.initial is None or isinstance(table.initial, Column) else table.initial
    if kind == "stream":
        return stateful.running(df.withColumn("key", table.group_by(F.col("key"), F.col("value"))), init, fold.add, fold.type, ttl_ms)
    if fold.subtract is None:
        raise KeyError(f"{name}: an aggregate of a table needs subtract")
    changed = stateful.replaced(df, ttl_ms)
    both = F.array(*(F.struct(F.lit(s).alias("sign"), F.col(f"value.{side}").alias("v")) for s, side in ((-1, "_2"), (1, "_1"))))
    moves = changed.select("key", F.explode(both).alias("m"), "ts", "seq").where("m.v is not null")
    moves = moves.select(table.group_by(F.col("key"), F.col("m.v")).alias("key"), F.col("m").alias("value"), "ts", "seq")

    def add(acc: Any, m: Any) -> Any:
        return fold.add(acc, m["v"]) if m["sign"] > 0 else fold.subtract(acc, m["v"])

    return stateful.running(moves, init, add, fold.type, ttl_ms)
