"""One query for each operator over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import xform as X
from weirflow.operators.joins import join_all, stream_stream
from weirflow.operators.relation import Relation, canonical
from weirflow.plans.batch import Result, run
from weirflow.plans.model import Agg, GlobalTable, Join, JoinWindow, SessionWindow, Stream, Suppress, Table, TimeWindow, Topic, Topology
from weirflow.plans.workflow import dedupe_entities, with_dedupe
from weirflow.sources.io import decoded, encoded, read_topic, shared_folder
from weirflow.streaming.compile import compile_streams
from weirflow.streaming.stateful import STATE_PROVIDER

HOUR = 3_600_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- sources -------------------------------------------------------------------------------


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Events keyed by user, with the value in cents."""
    df = spark.read.parquet(f"{d}/events.parquet")
    if kind:
        df = df.where(F.col("event_type") == kind)
    return canonical(df, "user_id", cents("value"), "ts", "event_id")


def typed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events keyed by user, with type and cents in the value."""
    df = spark.read.parquet(f"{d}/events.parquet")
    return canonical(df, "user_id", F.struct(F.col("event_type").alias("kind"), cents("value").alias("cents")), "ts", "event_id")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders keyed by customer, with the price in cents."""
    return canonical(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", cents("o_totalprice"), "o_orderdate", "o_orderkey")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers by key, with their nation."""
    return canonical(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey", F.col("c_nationkey").cast("long"), F.timestamp_millis(F.lit(0)), "c_custkey")


def nations(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey").cast("long"), "n_name", F.timestamp_millis(F.lit(0)), "n_nationkey")


# ---- topologies and results ----------------------------------------------------------------


def chain(entities: dict, joins: dict | None = None, edges: list | None = None, overrides: dict | None = None) -> Topology:
    names = list(entities)
    return Topology(edges or list(zip(names, names[1:], strict=False)), entities, joins or {}, overrides or {})


def stream_of(*steps, keep_key: bool = False) -> Topology:
    return chain({"in": Topic("in"), "stream": Stream(steps, keep_key), "out": Topic("out")})


def table_of(table: Table) -> Topology:
    return chain({"in": Topic("in"), "table": table, "out": Topic("out")})


def joined(left: object, right: object, join: Join, out: object | None = None) -> Topology:
    """Topics l and r through entities a and b into j."""
    entities = {"l": Topic("l"), "r": Topic("r"), "a": left, "b": right, "j": out or Stream(), "out": Topic("out")}
    return Topology([("l", "a"), ("r", "b"), ("a", "j"), ("b", "j"), ("j", "out")], entities, {("a", "b"): join})


def micros(c: str, name: str) -> Column:
    return F.unix_micros(c).alias(name)


def flat(df: DataFrame, *values: Column) -> DataFrame:
    """Key, values and time as scalars."""
    return df.select("key", *(values or [F.col("value")]), micros("ts", "ts_us"))


def pair(a: str = "a", b: str = "b") -> list[Column]:
    return [F.col("value._1").alias(a), F.col("value._2").alias(b)]


def query(sql: str | None = None):
    """Registers a query under its function's name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


EV = "(select user_id as key, cast(round(value*100) as bigint) as value, ts, event_id as seq, event_type from events)"
OR = "(select o_custkey as key, cast(round(o_totalprice*100) as bigint) as value, o_orderdate as ts, o_orderkey as seq from orders)"


# ---- stateless -----------------------------------------------------------------------------


@query(f"select key, value, epoch_us(ts) as ts_us from {EV}")
def topic_to_topic(spark, d):
    return flat(run(chain({"in": Topic("in"), "out": Topic("out")}), {"in": events(spark, d)})["out"])


@query(f"select key, value + 1 as value, epoch_us(ts) as ts_us from {EV}")
def stream_map(spark, d):
    return flat(run(stream_of(X.map_kv(lambda k, v: k, lambda k, v: v + 1)), {"in": events(spark, d)})["out"])


@query(f"select key, value, epoch_us(ts) as ts_us from {EV} where value % 2 = 0 and key > 10")
def stream_filter(spark, d):
    return flat(run(stream_of(X.filter_kv(lambda k, v: (v % 2 == 0) & (k > 10))), {"in": events(spark, d)})["out"])


@query(f"select key, value + 1 as value, epoch_us(ts) as ts_us from {EV} where (value + 1) % 2 = 0")
def stream_map_filter(spark, d):
    return flat(run(stream_of(X.transform_value(lambda v: v + 1), X.value_pred(lambda v: v % 2 == 0)), {"in": events(spark, d)})["out"])


@query(f"select key, value + x as value, epoch_us(ts) as ts_us from {EV}, (values (1), (-1)) t(x)")
def stream_mapcat(spark, d):
    return flat(run(stream_of(X.flat_map(lambda k, v: [(k, v + 1), (k, v - 1)])), {"in": events(spark, d)})["out"])


@query(f"select key, unnest([value - 1, value, value * 2]) as value, epoch_us(ts) as ts_us from {EV}")
def transform_values(spark, d):
    return flat(run(stream_of(X.transform_values(lambda v: F.array(v - 1, v, v * 2))), {"in": events(spark, d)})["out"])


@query(f"select concat('user-', key) as key, value, epoch_us(ts) as ts_us from {EV}")
def transform_key(spark, d):
    return flat(run(stream_of(X.transform_key(lambda k: F.concat(F.lit("user-"), k.cast("string")))), {"in": events(spark, d)})["out"])


@query(f"select key, value, epoch_us(ts) as ts_us from {EV} where key % 3 = 0")
def key_filter(spark, d):
    return flat(run(stream_of(X.key_pred(lambda k: k % 3 == 0)), {"in": events(spark, d)})["out"])


@query(f"select key, value, epoch_us(ts) as ts_us from {EV} where value > 5000")
def value_filter(spark, d):
    return flat(run(stream_of(X.value_pred(lambda v: v > 5000)), {"in": events(spark, d)})["out"])


@query(f"select key, value + 1 as value, epoch_us(ts) as ts_us from {EV}")
def value_only_xform(spark, d):
    """The steps change the key, but the input's key stays."""
    return flat(run(stream_of(X.map_kv(lambda k, v: F.lit("new key"), lambda k, v: v + 1), keep_key=True), {"in": events(spark, d)})["out"])


def _doubled(batches):
    for b in batches:
        b["value"] = b["value"] * 2
        yield b


@query(f"select key, value * 2 as value, epoch_us(ts) as ts_us from {EV}")
def python_xform(spark, d):
    """An opaque step over Arrow batches."""
    return flat(run(stream_of(X.python_step(_doubled)), {"in": events(spark, d)})["out"])


@query(f"select key, value, epoch_us(ts) as ts_us from {EV} where event_type in ('purchase', 'view')")
def merge_streams(spark, d):
    topology = joined(Stream(), Stream(), Join("merge"))
    return flat(run(topology, {"l": events(spark, d, "purchase"), "r": events(spark, d, "view")})["out"])


@query(f"select key, value, epoch_us(ts) as ts_us from {EV} where event_type in ('purchase', 'view')")
def multi_parent_sink(spark, d):
    topology = Topology([("l", "out"), ("r", "out")], {"l": Topic("l"), "r": Topic("r"), "out": Topic("out")})
    return flat(run(topology, {"l": events(spark, d, "purchase"), "r": events(spark, d, "view")})["out"])


@query(f"select key, sum(value)::bigint as value from (select key % 10 as key, value + 1 as value from {EV}) group by key")
def intermediate_topic(spark, d):
    """A topic between two entities."""
    table = Table(lambda k, v: k, Agg.sum())
    topology = chain({"in": Topic("in"), "s": Stream([X.map_kv(lambda k, v: k % 10, lambda k, v: v + 1)]), "mid": Topic("mid"), "t": table, "out": Topic("out")})
    return run(topology, {"in": events(spark, d)}).snapshot("t").select("key", "value")


@query(f"select 'a' as sink, key, value + 1 as value from {EV} union all select 'b', key, value + 1 from {EV}")
def fan_out(spark, d):
    topology = Topology([("in", "s"), ("s", "a"), ("s", "b")], {"in": Topic("in"), "s": Stream([X.transform_value(lambda v: v + 1)]), "a": Topic("a"), "b": Topic("b")})
    r = run(topology, {"in": events(spark, d)})
    return r["a"].select(F.lit("a").alias("sink"), "key", "value").unionByName(r["b"].select(F.lit("b").alias("sink"), "key", "value"))


@query(f"select key, value, epoch_us(ts) as ts_us from {EV} where event_type = 'view' union all select key, value * 10, epoch_us(ts) from {EV} where event_type = 'purchase'")
def seeded_entity(spark, d):
    """Rows injected at an inner entity join those it computes."""
    return flat(run(stream_of(X.transform_value(lambda v: v * 10)), {"in": events(spark, d, "purchase"), "stream": events(spark, d, "view")})["out"])


@query(f"select key, -value as value, epoch_us(ts) as ts_us from {EV}")
def custom_operator(spark, d):
    topology = chain({"in": Topic("in"), "x": Stream(), "out": Topic("out")}, overrides={"x": lambda entity, parents, made: parents[0].changelog.withColumn("value", -F.col("value"))})
    return flat(run(topology, {"in": events(spark, d)})["out"])


# ---- tables and aggregates -----------------------------------------------------------------


@query(f"select key, arg_max(value, seq) as value, max(epoch_us(ts)) as ts_us from {EV} group by key")
def table_latest(spark, d):
    return flat(run(table_of(Table()), {"in": events(spark, d)}).snapshot("table"))


@query(f"select key, value, epoch_us(ts) as ts_us from {EV}")
def table_changelog(spark, d):
    return flat(run(table_of(Table()), {"in": events(spark, d)})["out"])


@query(f"select key, sum(value) over (partition by key order by ts, seq rows unbounded preceding)::bigint as value, epoch_us(ts) as ts_us from {EV}")
def table_changelog_sum(spark, d):
    return flat(run(table_of(Table(lambda k, v: k, Agg.sum())), {"in": events(spark, d)})["out"])


@query(f"select key, count(*) as n, sum(value)::bigint as total, min(value) as low, max(value) as high, avg(value) as mean, arg_max(value, seq) as last from {EV} group by key")
def keyed_aggregates(spark, d):
    """Several aggregates of one table, in one pass."""
    each = Agg.several(n=Agg.count(), total=Agg.sum(), low=Agg.min(), high=Agg.max(), mean=Agg.avg(), last=Agg.latest())
    return run(table_of(Table(lambda k, v: k, each)), {"in": events(spark, d)}).snapshot("table").select("key", "value.*")


@query(f"select key, 100 + sum(value)::bigint as total, 5 + count(*) as n, least(min(value), 50) as low, greatest(max(value), 50000) as high from {EV} group by key")
def aggregate_initial(spark, d):
    """Aggregates that start from a value of their own."""
    each = Agg.several(total=Agg.sum(), n=Agg.count(), low=Agg.min(), high=Agg.max())
    start = {"total": 100, "n": 5, "low": 50, "high": 50_000}
    return run(table_of(Table(lambda k, v: k, each, initial=start)), {"in": events(spark, d)}).snapshot("table").select("key", "value.*")


@query(f"select key, (7 + sum(value) over (partition by key order by ts, seq rows unbounded preceding))::bigint as value, epoch_us(ts) as ts_us from {EV}")
def aggregate_initial_changelog(spark, d):
    return flat(run(table_of(Table(lambda k, v: k, Agg.sum(), initial=7)), {"in": events(spark, d)})["out"])


@query(f"select key, arg_max(value, seq) as value from {EV} group by key")
def second_store(spark, d):
    """A table under another store's name has the same rows."""
    topology = chain({"in": Topic("in"), "a": Table(store="first"), "b": Table(store="second"), "out": Topic("out")})
    return run(topology, {"in": events(spark, d)}).snapshot("b").select("key", "value")


@query(f"select key, sum(value)::bigint as value from {EV} group by key")
def store_view(spark, d):
    """A table read by the name of its store."""
    result = run(table_of(Table(lambda k, v: k, Agg.sum(), store="totals_by_user")), {"in": events(spark, d)})
    result.open_stores()
    return spark.table("totals_by_user").select("key", "value")


@query(f"select value % 7 as key, sum(value)::bigint as value from {EV} group by 1")
def group_by_value_agg(spark, d):
    return run(table_of(Table(lambda k, v: v % 7, Agg.sum())), {"in": events(spark, d)}).snapshot("table").select("key", "value")


@query(f"select key, array_to_string(list(value order by ts, seq), ',') as value from {EV} group by key")
def collect_in_order(spark, d):
    return run(table_of(Table(lambda k, v: k, Agg.collect())), {"in": events(spark, d)}).snapshot("table").select("key", F.array_join(F.col("value").cast("array<string>"), ",").alias("value"))


@query(f"select key, list_reduce(list_prepend(0::bigint, list(value order by ts, seq)), lambda a, x: (a * 31 + x) % 1000003) as value from {EV} group by key")
def ordered_fold(spark, d):
    """A fold that depends on the order."""
    fold = Agg.fold(F.lit(0).cast("long"), lambda acc, k, v: (acc * 31 + v) % 1000003)
    return run(table_of(Table(lambda k, v: k, fold)), {"in": events(spark, d)}).snapshot("table").select("key", "value")


@query(f"select key, list_reduce(list_prepend(0::bigint, list(value) over (partition by key order by ts, seq rows unbounded preceding)), lambda a, x: (a * 31 + x) % 1000003) as value, epoch_us(ts) as ts_us from {EV}")
def ordered_fold_changelog(spark, d):
    fold = Agg.fold(F.lit(0).cast("long"), lambda acc, k, v: (acc * 31 + v) % 1000003)
    return flat(run(table_of(Table(lambda k, v: k, fold)), {"in": events(spark, d)})["out"])


LATEST = "(select user_id as key, arg_max(event_type, event_id) as kind, cast(round(arg_max(value, event_id)*100) as bigint) as cents from events group by 1)"


@query(f"select kind as key, sum(cents)::bigint as value from {LATEST} group by 1")
def table_agg_retract(spark, d):
    """Sum over each user's latest event, by its type: an update leaves the old type's sum."""
    topology = chain({"in": Topic("in"), "users": Table(), "kinds": Table(lambda k, v: v["kind"], Agg.sum(lambda k, v: v["cents"])), "out": Topic("out")})
    return run(topology, {"in": typed_events(spark, d)}).snapshot("kinds").select("key", "value")


DELTAS = """
with e as (select user_id, event_type as kind, cast(round(value*100) as bigint) as cents, ts, event_id as seq,
  lag(event_type) over w as old_kind, lag(cast(round(value*100) as bigint)) over w as old_cents from events window w as (partition by user_id order by ts, event_id)),
x as (select kind as key, cents as v, 1 as sign, ts, seq from e union all select old_kind, -old_cents, -1, ts, seq from e where old_kind is not null)
"""


@query(DELTAS + "select key, (sum(v) over (partition by key order by ts, seq, sign rows unbounded preceding))::bigint as value, epoch_us(ts) as ts_us from x")
def table_agg_retract_changelog(spark, d):
    topology = chain({"in": Topic("in"), "users": Table(), "kinds": Table(lambda k, v: v["kind"], Agg.sum(lambda k, v: v["cents"])), "out": Topic("out")})
    return flat(run(topology, {"in": typed_events(spark, d)})["out"])


@query(f"select kind as key, sum(cents)::bigint as value from {LATEST} group by 1")
def table_fold_retract(spark, d):
    """The same by a user's own adder and subtractor."""
    fold = Agg.fold(F.lit(0).cast("long"), lambda a, k, v: a + v["cents"], lambda a, k, v: a - v["cents"])
    topology = chain({"in": Topic("in"), "users": Table(), "kinds": Table(lambda k, v: v["kind"], fold), "out": Topic("out")})
    return run(topology, {"in": typed_events(spark, d)}).snapshot("kinds").select("key", "value")


@query(f"select kind as key, max(cents) as value from {LATEST} group by 1")
def table_agg_max(spark, d):
    """An aggregate that can't be taken back, over the latest rows."""
    topology = chain({"in": Topic("in"), "users": Table(), "kinds": Table(lambda k, v: v["kind"], Agg.max(lambda k, v: v["cents"])), "out": Topic("out")})
    return run(topology, {"in": typed_events(spark, d)}).snapshot("kinds").select("key", "value")


AVG = "select kind as key, avg(cents) as value from " + LATEST + " group by 1"


def by_kind(spark, d, agg) -> Result:
    """An aggregate over each user's latest event, by its type."""
    topology = chain({"in": Topic("in"), "users": Table(), "kinds": Table(lambda k, v: v["kind"], agg), "out": Topic("out")})
    return run(topology, {"in": typed_events(spark, d)})


@query(AVG)
def table_agg_avg_retract(spark, d):
    return by_kind(spark, d, Agg.avg(lambda k, v: v["cents"])).snapshot("kinds").select("key", "value")


@query(DELTAS + "select key, sum(v) over w / nullif(sum(sign) over w, 0) as value, epoch_us(ts) as ts_us from x window w as (partition by key order by ts, seq, sign rows unbounded preceding)")
def table_agg_avg_retract_changelog(spark, d):
    """A group that loses its last row has no average."""
    return flat(by_kind(spark, d, Agg.avg(lambda k, v: v["cents"]))["out"])


@query(DELTAS + """, lives as (select event_type as kind, cast(round(value*100) as bigint) as cents, event_id as born, lead(event_id) over (partition by user_id order by ts, event_id) as gone from events)
select x.key, x.sign, max(cents) as value, min(cents) as low, epoch_us(x.ts) as ts_us from x
left join lives on kind = x.key and (born < x.seq or x.sign = 1 and born = x.seq) and (gone is null or gone > x.seq) group by x.key, x.sign, x.ts, x.seq""")
def table_agg_max_changelog(spark, d):
    """Maximum and minimum of the rows that are in a group, whenever one comes or leaves."""
    changes = by_kind(spark, d, Agg.several(high=Agg.max(lambda k, v: v["cents"]), low=Agg.min(lambda k, v: v["cents"]), n=Agg.count()))["out"]
    more = Window.partitionBy("key").orderBy("ts", "seq", F.monotonically_increasing_id())
    sign = F.sign(F.col("value.n") - F.coalesce(F.lag("value.n").over(more), F.lit(0))).cast("int")
    return changes.select("key", sign.alias("sign"), F.col("value.high").alias("value"), F.col("value.low").alias("low"), micros("ts", "ts_us"))


# ---- windows -------------------------------------------------------------------------------


def windowed(spark, d, window, agg=None, **more) -> Result:
    return run(table_of(Table(lambda k, v: k, agg or Agg.sum(), window, **more)), {"in": events(spark, d)})


def win_flat(df: DataFrame) -> DataFrame:
    return df.select("key", "value", micros("win.start", "start_us"), micros("win.end", "end_us"))


TUMBLING = f"select key, sum(value)::bigint as value, epoch_us(ts) // 3600000000 * 3600000000 as start_us, epoch_us(ts) // 3600000000 * 3600000000 + 3600000000 as end_us from {EV} group by all"


@query(TUMBLING)
def tumbling_agg(spark, d):
    return win_flat(windowed(spark, d, TimeWindow(HOUR)).snapshot("table"))


@query(f"select key, (sum(value) over (partition by key, epoch_us(ts) // 3600000000 order by ts, seq rows unbounded preceding))::bigint as value, epoch_us(ts) as ts_us from {EV}")
def tumbling_changelog(spark, d):
    return flat(windowed(spark, d, TimeWindow(HOUR))["out"])


@query(f"select key, sum(value)::bigint as value, s as start_us, s + 3600000000 as end_us from (select key, value, (epoch_us(ts) // 1800000000 - i) * 1800000000 as s from {EV}, (values (0), (1)) t(i)) where s >= 0 group by key, s")
def hopping_agg(spark, d):
    return win_flat(windowed(spark, d, TimeWindow(HOUR, HOUR // 2)).snapshot("table"))


SESSIONS = f"""
with a as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by key order by ts, seq) <= 21600000000 then 0 else 1 end as new from {EV}),
b as (select *, sum(new) over (partition by key order by ts, seq rows unbounded preceding) as s from a)
"""


@query(SESSIONS + "select key, sum(value)::bigint as value, min(epoch_us(ts)) as start_us, max(epoch_us(ts)) + 21600000000 as end_us from b group by key, s")
def session_agg(spark, d):
    return win_flat(windowed(spark, d, SessionWindow(6 * HOUR)).snapshot("table"))


@query(SESSIONS + "select key, (sum(value) over (partition by key, s order by ts, seq rows unbounded preceding))::bigint as value, epoch_us(ts) as ts_us from b")
def session_changelog(spark, d):
    return flat(windowed(spark, d, SessionWindow(6 * HOUR))["out"])


@query(TUMBLING)
def suppress_final(spark, d):
    """A windowed table that shows only each window's last row."""
    return win_flat(windowed(spark, d, TimeWindow(HOUR), suppress=Suppress())["table"])


@query(f"select key, arg_max(total, seq)::bigint as value, max(epoch_us(ts)) as ts_us from (select *, sum(value) over (partition by key order by ts, seq rows unbounded preceding) as total from {EV}) group by key, epoch_us(ts) // 3600000000")
def suppress_time_limit(spark, d):
    table = Table(lambda k, v: k, Agg.sum(), suppress=Suppress("time_limit", HOUR))
    return flat(run(table_of(table), {"in": events(spark, d)})["table"])


@query(f"select key, (sum(value) over (partition by key order by ts, seq rows unbounded preceding))::bigint as value, epoch_us(ts) as ts_us from {EV}")
def windowed_table_as_stream(spark, d):
    """A windowed table's updates as events: the window leaves the key; here one window holds everything."""
    return flat(windowed(spark, d, TimeWindow(HOUR * 24 * 365 * 1000))["out"])


# ---- stream joins --------------------------------------------------------------------------

L, R = f"(select * from {EV} where event_type = 'purchase') l", f"(select * from {EV} where event_type = 'view') r"
NEAR = "l.key = r.key and r.ts between l.ts - interval 1 hour and l.ts + interval 1 hour"
COLS = "coalesce(l.key, r.key) as key, l.value as a, r.value as b, epoch_us(greatest(l.ts, r.ts)) as ts_us"


def two_streams(spark, d, join: Join) -> DataFrame:
    return flat(run(joined(Stream(), Stream(), join), {"l": events(spark, d, "purchase"), "r": events(spark, d, "view")})["out"], *pair())


@query(f"select {COLS} from {L} join {R} on {NEAR}")
def stream_join_inner(spark, d):
    return two_streams(spark, d, Join("inner", JoinWindow(HOUR)))


@query(f"select {COLS} from {L} join {R} on {NEAR}")
def stream_join_inner_sliced(spark, d):
    """The same with hot keys cut into slices of time."""
    return flat(stream_stream(events(spark, d, "purchase"), events(spark, d, "view"), Join("inner", JoinWindow(HOUR)), slices=True), *pair())


@query(f"select {COLS} from {L} left join {R} on {NEAR}")
def stream_join_left_final(spark, d):
    return two_streams(spark, d, Join("left", JoinWindow(HOUR)))


@query(f"select {COLS} from {L} full join {R} on {NEAR}")
def stream_join_outer_final(spark, d):
    return two_streams(spark, d, Join("outer", JoinWindow(HOUR)))


EAGER = f"select {COLS} from {L} join {R} on {NEAR} union all select l.key, l.value, null, epoch_us(l.ts) from {L} where not exists (select 1 from {R} where l.key = r.key and r.ts between l.ts - interval 1 hour and l.ts)"


@query(EAGER)
def stream_join_left_eager(spark, d):
    return two_streams(spark, d, Join("left", JoinWindow(HOUR), eager=True))


@query(EAGER + f" union all select r.key, null, r.value, epoch_us(r.ts) from {R} where not exists (select 1 from {L} where l.key = r.key and l.ts between r.ts - interval 1 hour and r.ts)")
def stream_join_outer_eager(spark, d):
    return two_streams(spark, d, Join("outer", JoinWindow(HOUR), eager=True))


@query(f"select {COLS} from {L} join {R} on l.key = r.key and r.ts between l.ts - interval 10 minute and l.ts + interval 6 hour")
def stream_join_asymmetric(spark, d):
    return two_streams(spark, d, Join("inner", JoinWindow(HOUR // 6, 6 * HOUR)))


def stream_and_table(spark, d, how: str) -> DataFrame:
    return flat(run(joined(Stream(), Table(), Join(how)), {"l": events(spark, d, "purchase"), "r": events(spark, d, "view")})["out"], *pair())


@query(f"select l.key, l.value as a, r.value as b, epoch_us(l.ts) as ts_us from {L} asof left join {R} on l.key = r.key and l.ts >= r.ts")
def asof_left(spark, d):
    return stream_and_table(spark, d, "left")


@query(f"select l.key, l.value as a, r.value as b, epoch_us(l.ts) as ts_us from {L} asof join {R} on l.key = r.key and l.ts >= r.ts")
def asof_inner(spark, d):
    return stream_and_table(spark, d, "inner")


def with_global(spark, d, join: Join) -> DataFrame:
    entities = {"l": Topic("l"), "r": Topic("r"), "a": Stream(), "g": GlobalTable(), "j": Stream(), "out": Topic("out")}
    topology = Topology([("l", "a"), ("r", "g"), ("a", "j"), ("g", "j"), ("j", "out")], entities, {("a", "g"): join})
    return topology


CUST = "(select c_custkey, c_nationkey::bigint as c_nationkey from customer)"


@query(f"select o.key, o.value as a, c.c_nationkey as b, epoch_us(o.ts) as ts_us from {OR} o join {CUST} c on o.key = c.c_custkey")
def global_inner(spark, d):
    return flat(run(with_global(spark, d, Join("inner")), {"l": orders(spark, d), "r": customers(spark, d)})["out"], *pair())


@query(f"select o.key, o.value as a, c.n_name as b, epoch_us(o.ts) as ts_us from {OR} o left join nation c on o.key = c.n_nationkey")
def global_left(spark, d):
    """Most orders' customers are no nation's number, and have no name."""
    return flat(run(with_global(spark, d, Join("left")), {"l": orders(spark, d), "r": nations(spark, d)})["out"], *pair())


@query("select c_custkey as key, c_nationkey::bigint as a, n_name as b, 0::bigint as ts_us from customer join nation on c_nationkey = n_nationkey")
def global_kv_mapper(spark, d):
    """The key to look up is the value."""
    return flat(run(with_global(spark, d, Join("inner", lookup=lambda k, v: v)), {"l": customers(spark, d), "r": nations(spark, d)})["out"], *pair())


# ---- table joins ---------------------------------------------------------------------------

SNAP = "(select key, arg_max(value, seq) as value, max(epoch_us(ts)) as ts_us from {} group by key)".format


def two_tables(spark, d, how: str) -> Result:
    return run(joined(Table(), Table(), Join(how), Table()), {"l": events(spark, d, "purchase"), "r": events(spark, d, "view")})


def table_sql(how: str) -> str:
    return f"select coalesce(l.key, r.key) as key, l.value as a, r.value as b, greatest(l.ts_us, r.ts_us) as ts_us from {SNAP(L[:-2])} l {how} join {SNAP(R[:-2])} r on l.key = r.key"


def changes_sql(need: str) -> str:
    return f"""
with u as (select key, ts, seq, 0 as side, value as a, null::bigint as b from {L} union all select key, ts, seq, 1, null, value from {R}),
c as (select key, ts, last_value(a ignore nulls) over w as a, last_value(b ignore nulls) over w as b from u
  window w as (partition by key order by ts, side, seq rows unbounded preceding))
select key, a, b, epoch_us(ts) as ts_us from c where {need}"""


@query(table_sql("inner"))
def table_join_inner(spark, d):
    return flat(two_tables(spark, d, "inner").snapshot("j"), *pair())


@query(table_sql("left"))
def table_join_left(spark, d):
    return flat(two_tables(spark, d, "left").snapshot("j"), *pair())


@query(table_sql("full"))
def table_join_outer(spark, d):
    return flat(two_tables(spark, d, "outer").snapshot("j"), *pair())


@query(changes_sql("a is not null and b is not null"))
def table_join_inner_changelog(spark, d):
    return flat(two_tables(spark, d, "inner")["out"], *pair())


@query(changes_sql("a is not null"))
def table_join_left_changelog(spark, d):
    return flat(two_tables(spark, d, "left")["out"], *pair())


@query(changes_sql("true"))
def table_join_outer_changelog(spark, d):
    return flat(two_tables(spark, d, "outer")["out"], *pair())


def many(spark, d, kinds: list[str], join: Join) -> DataFrame:
    names = [f"t{i}" for i in range(len(kinds))]
    entities = {f"in{i}": Topic(f"in{i}") for i in range(len(kinds))} | {n: Table() for n in names} | {"j": Table(), "out": Topic("out")}
    edges = [(f"in{i}", n) for i, n in enumerate(names)] + [(n, "j") for n in names] + [("j", "out")]
    r = run(Topology(edges, entities, {tuple(names): join}), {f"in{i}": events(spark, d, k) for i, k in enumerate(kinds)})
    return r.snapshot("j")


def many_sql(kinds: list[str], how: str) -> str:
    parts = [SNAP(f"(select * from {EV} where event_type = '{k}')") for k in kinds]
    first = f"{parts[0]} t0"
    for i, p in enumerate(parts[1:], 1):
        first += f" {how} join {p} t{i} on t{i}.key = t0.key"
    return f"select t0.key, {', '.join(f't{i}.value as v{i}' for i in range(len(kinds)))} from {first}"


@query(f"select key, value, epoch_us(ts) as ts_us from {EV}")
def unary_join(spark, d):
    """A join of one input is that input."""
    return flat(join_all([Relation("stream", events(spark, d))], Join("inner")).changelog)


@query(many_sql(["purchase", "view", "click"], "inner"))
def nary_join_3(spark, d):
    """Three inputs make one struct of three."""
    return many(spark, d, ["purchase", "view", "click"], Join("inner")).select("key", *(F.col(f"value._{i + 1}").alias(f"v{i}") for i in range(3)))


@query(many_sql(["purchase", "view", "click", "error"], "inner"))
def nary_join_4(spark, d):
    """Four make a struct of three inside a pair."""
    return many(spark, d, ["purchase", "view", "click", "error"], Join("inner")).select("key", *(F.col(f"value._1._{i + 1}").alias(f"v{i}") for i in range(3)), F.col("value._2").alias("v3"))


@query(many_sql(["purchase", "view", "click", "error"], "left"))
def nary_join_4_flat(spark, d):
    return many(spark, d, ["purchase", "view", "click", "error"], Join("left", flatten=True)).select("key", *(F.col(f"value._{i + 1}").alias(f"v{i}") for i in range(4)))


# ---- fragments -----------------------------------------------------------------------------


def deduped(spark, d, source: DataFrame, of=None) -> DataFrame:
    entities, overrides = dedupe_entities("x", of)
    topology = Topology(with_dedupe("x", "in", "out"), {"in": Topic("in"), "out": Topic("out"), **entities}, overrides=overrides)
    return run(topology, {"in": source})["out"]


@query(f"select key, value % 5 as value, min(epoch_us(ts)) as ts_us from {EV} group by 1, 2")
def dedupe(spark, d):
    """The first of each key and value."""
    return flat(deduped(spark, d, events(spark, d).withColumn("value", F.col("value") % 5)))


@query("select user_id as key, event_type as kind, cast(round(arg_min(value, event_id) * 100) as bigint) as cents, min(epoch_us(ts)) as ts_us from events group by 1, 2")
def dedupe_by_id(spark, d):
    """The first of each key and id of the value."""
    return flat(deduped(spark, d, typed_events(spark, d), lambda v: v["kind"]), F.col("value.kind").alias("kind"), F.col("value.cents").alias("cents"))


# ---- storage and streams -------------------------------------------------------------------


@query(f"select key, value + 1 as value, epoch_us(ts) as ts_us from {EV} union all select key, value * 2, epoch_us(ts) from {EV}")
def topic_sink(spark, d):
    """Two streams written to one topic, read back from storage."""
    topology = Topology([("in", "a"), ("in", "b"), ("a", "out"), ("b", "out")], {"in": Topic("in"), "a": Stream([X.transform_value(lambda v: v + 1)]), "b": Stream([X.transform_value(lambda v: v * 2)]), "out": Topic("sums")})
    folder = shared_folder(spark)
    run(topology, {"in": events(spark, d)}).write(folder)
    return flat(read_topic(spark, f"{folder}/sums"))


@query("select user_id as key, event_type as kind, cast(round(value*100) as bigint) as cents from events")
def topic_codec(spark, d):
    """Keys and values as text, and back."""
    rows = typed_events(spark, d)
    back = decoded(encoded(rows), rows.schema["key"].dataType, rows.schema["value"].dataType)
    return back.select("key", F.col("value.kind").alias("kind"), F.col("value.cents").alias("cents"))


@query(f"select key, max(value)::bigint as value, count(*) as n from (select key, sum(value) over (partition by key, epoch_us(ts) // 3600000000 order by ts, seq rows unbounded preceding) as value from {EV}) group by key")
def windowed_unwrap(spark, d):
    """The updates of hourly sums as events of the plain key."""
    each = Agg.several(value=Agg.max(), n=Agg.count())
    topology = chain({"in": Topic("in"), "hours": Table(lambda k, v: k, Agg.sum(), TimeWindow(HOUR)), "updates": Stream(), "most": Table(lambda k, v: k, each), "out": Topic("out")})
    return run(topology, {"in": events(spark, d)}).snapshot("most").select("key", "value.*")


@query(f"select key, value, epoch_us(ts) // 3600000000 * 3600000000 as start_us from (select user_id as key, sum(round(value*100)::bigint) over (partition by user_id, epoch_us(ts) // 3600000000 order by ts, event_id rows unbounded preceding)::bigint as value, ts from events) union all select o_custkey, round(o_totalprice*100)::bigint, epoch_us(o_orderdate) // 3600000000 * 3600000000 from orders")
def seeded_window(spark, d):
    """Rows put straight into a windowed table, beside what it computes."""
    topology = table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(HOUR)))
    result = run(topology, {"in": events(spark, d), "table": orders(spark, d)})
    return result["table"].select("key", "value", micros("win.start", "start_us"))


def streamed(spark, topology: Topology, d: str, tables=None) -> DataFrame:
    """What a stream over all events leaves in its only topic."""
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")  # a pattern, as the table may be one file
    source = canonical(raw, "user_id", cents("value"), "ts", "event_id").withWatermark("ts", "0 seconds")
    folder, held = shared_folder(spark), spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, STATE_PROVIDER)
    try:
        plan = compile_streams(topology, {"in": source}, tables)
        plan.start(f"{folder}/topics", f"{folder}/checkpoints", once=True)
        plan.await_all()
    finally:
        spark.conf.set(STATE_STORE, held) if held else spark.conf.unset(STATE_STORE)
    ((name, df),) = plan.sinks().items()
    return spark.read.schema(df.schema).parquet(f"{folder}/topics/{name}")


@query(f"select key, value + 1 as value, epoch_us(ts) as ts_us from {EV} where (value + 1) % 2 = 0")
def streaming_steps(spark, d):
    return flat(streamed(spark, stream_of(X.transform_value(lambda v: v + 1), X.value_pred(lambda v: v % 2 == 0)), d))


@query(f"select key, sum(value)::bigint as value from {EV} group by key, epoch_us(ts) // 3600000000 having epoch_us(min(ts)) // 3600000000 * 3600000000 + 3600000000 <= (select max(epoch_us(ts)) from events)")
def streaming_closed_windows(spark, d):
    """Hourly sums, each when the watermark has passed its end."""
    return streamed(spark, table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(HOUR), Suppress())), d).select("key", "value")


@query(f"select key, (sum(value) over (partition by key, epoch_us(ts) // 3600000000 order by ts, seq rows unbounded preceding))::bigint as value, epoch_us(ts) as ts_us from {EV}")
def streaming_each_update(spark, d):
    """Hourly sums, after each event."""
    return flat(streamed(spark, table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(HOUR))), d))


@query(f"select key, value % 5 as value from {EV} group by 1, 2")
def streaming_dedupe(spark, d):
    entities, overrides = dedupe_entities("x")
    topology = Topology([("in", "five"), *with_dedupe("x", "five", "out")], {"in": Topic("in"), "five": Stream([X.transform_value(lambda v: v % 5)]), "out": Topic("out"), **entities}, overrides=overrides)
    return streamed(spark, topology, d).select("key", "value")


@query(f"""select user_id as key, sum(c)::bigint as value from (select user_id, cast(round(value*100) as bigint) + 1 as c from events) where c % 2 = 0 group by user_id""")
def flagship(spark, d):
    """Topic, stream with map and filter, table with group-by and sum, topic."""
    topology = chain({"in": Topic("events"), "s": Stream([X.transform_value(lambda v: v + 1), X.value_pred(lambda v: v % 2 == 0)]), "t": Table(lambda k, v: k, Agg.sum()), "out": Topic("totals")})
    return run(topology, {"in": events(spark, d)}).snapshot("t").select("key", "value")
