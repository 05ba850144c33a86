"""Aggregates that rows leave again, initial values, stores, seeds and text codecs."""

import random

import pytest
from helpers import listed, plain, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import xform as X
from weirflow.plans import viz
from weirflow.plans.batch import run
from weirflow.plans.model import Agg, GlobalTable, Join, SessionWindow, Stream, Table, TimeWindow, Topic, Topology
from weirflow.plans.validate import TopologyError
from weirflow.queries import chain, stream_of, table_of
from weirflow.sources.io import decoded, encoded

KINDS = {"sum": sum, "count": len, "min": min, "max": max, "avg": lambda x: sum(x) / len(x), "latest": lambda x: x[-1], "collect": list}
NONE = {"sum": 0, "count": 0, "collect": []}


def grouped(agg, initial=None):
    """A table of users, and an aggregate of their numbers by their group."""
    return chain({"in": Topic("in"), "users": Table(), "groups": Table(lambda k, v: v["g"], agg, initial=initial), "out": Topic("out")})


def moves(rng, n):
    """Users that come, change their number or group, and leave."""
    out = []
    for i in range(n):
        value = None if rng.random() < 0.15 else (rng.choice("ab"), rng.randrange(9))
        out.append((rng.choice("uvw"), value, 10 * i + rng.randrange(3)))
    return out


def by_hand(records, kind):
    """(group, aggregate) after each row that leaves or comes."""
    live, out = {}, []  # user -> (group, number), in order of coming
    told = lambda g: (g, KINDS[kind](x) if (x := [n for h, n in live.values() if h == g]) else NONE.get(kind))
    for user, value, _ in sorted(records, key=lambda r: r[2]):
        if user in live:
            g, _ = live.pop(user)
            out.append(told(g))
        if value is not None:
            live[user] = value
            out.append(told(value[0]))
    return out, {g: told(g)[1] for g in {g for g, _ in live.values()}}


@pytest.mark.parametrize("kind", KINDS)
def test_rows_leave_and_come(spark, kind):
    records = moves(random.Random(kind), 40)
    result = run(grouped(Agg.count() if kind == "count" else getattr(Agg, kind)(lambda k, v: v["n"])), {"in": rows(spark, records, value="struct<g:string,n:bigint>")})
    changes, last = by_hand(records, kind)
    got = [(r["key"], r["value"]) for r in result["groups"].collect()]
    for g in "ab":  # a group's updates come in order of time; two of one time in the order leaves, comes
        assert sorted(map(str, (x for k, x in got if k == g))) == sorted(map(str, (x for k, x in changes if k == g)))
    held = {r["key"]: r["value"] for r in result.snapshot("groups").collect()}
    assert {g: x for g, x in held.items() if x != NONE.get(kind)} == {g: x for g, x in last.items() if x != NONE.get(kind)}


def test_several_in_one_pass_as_one_by_one(spark):
    records = moves(random.Random(3), 30)
    data = rows(spark, records, value="struct<g:string,n:bigint>")
    of = lambda k, v: v["n"]
    parts = {"n": Agg.count(), "total": Agg.sum(of), "low": Agg.min(of), "last": Agg.latest(of), "each": Agg.collect(of)}
    result = run(grouped(Agg.several(**parts)), {"in": data})
    for name, agg in parts.items():
        one = run(grouped(agg), {"in": data})
        assert sorted(map(str, listed(result["groups"].withColumn("value", F.col(f"value.{name}"))))) == sorted(map(str, listed(one["groups"])))
    plan = result.snapshot("groups")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_a_fold_over_a_table_needs_subtract(spark):
    fold = Agg.fold(F.lit(0).cast("long"), lambda acc, k, v: acc + v["n"])
    with pytest.raises(ValueError, match="subtract"):
        run(grouped(fold), {"in": rows(spark, moves(random.Random(1), 5), value="struct<g:string,n:bigint>")})


@pytest.mark.parametrize(("agg", "initial", "want"), [(Agg.sum, 100, [101, 104]), (Agg.count, 5, [6, 7]), (Agg.min, 2, [1, 1]), (Agg.max, 2, [2, 3]), (Agg.collect, [9], [[9, 1], [9, 1, 3]])])
def test_initial_values(spark, agg, initial, want):
    topology = table_of(Table(lambda k, v: k, agg(), initial=initial))
    result = run(topology, {"in": rows(spark, [("k", 1, 0), ("k", 3, 10)])})
    assert [v for _, v in listed(result["out"])] == want
    assert [r["value"] for r in result.snapshot("table").collect()] == want[-1:]


def test_a_fold_starts_from_the_initial_value(spark):
    fold = Agg.fold(F.lit(0).cast("long"), lambda acc, k, v: acc * 2 + v)
    result = run(table_of(Table(lambda k, v: k, fold, initial=F.lit(7).cast("long"))), {"in": rows(spark, [("k", 1, 0), ("k", 3, 10)])})
    assert listed(result["out"]) == [("k", 15), ("k", 33)]


@pytest.mark.parametrize(("agg", "initial"), [(Agg.avg(), 1), (Agg.latest(), 1), (Agg.several(a=Agg.sum()), 3), (Agg.several(a=Agg.sum()), {"b": 1}), (Agg.several(a=Agg.avg()), {"a": 1})])
def test_what_has_no_initial_value(agg, initial):
    with pytest.raises(TopologyError, match="initial"):
        table_of(Table(lambda k, v: k, agg, initial=initial)).validated()


def test_several_takes_no_folds():
    with pytest.raises(ValueError, match="parts"):
        Agg.several()
    with pytest.raises(ValueError, match="parts"):
        Agg.several(a=Agg.several(b=Agg.sum()))


def test_a_null_removes_a_key(spark):
    result = run(table_of(Table()), {"in": rows(spark, [("k", 1, 0), ("j", 2, 5), ("k", None, 10)])})
    assert listed(result.snapshot("table")) == [("j", 2)]
    assert listed(result["table"]) == [("k", 1), ("j", 2), ("k", None)]


def test_stores_are_views(spark):
    entities = {"in": Topic("in"), "a": Table(lambda k, v: k, Agg.sum(), store="sums"), "b": Table(store="again"), "out": Topic("out")}
    result = run(chain(entities), {"in": rows(spark, [("k", 1, 0), ("k", 2, 5)])})
    assert result.stores() == {"a": "sums", "b": "again"}
    assert result.open_stores() == ["again", "sums"]
    assert listed(spark.table("sums")) == listed(spark.table("again")) == [("k", 3)]
    twice = chain({"in": Topic("in"), "a": Table(store="x"), "b": Table(store="x"), "out": Topic("out")})
    with pytest.raises(ValueError, match="one store"):
        run(twice, {"in": rows(spark, [("k", 1, 0)])}).open_stores()


@pytest.mark.parametrize("window", [TimeWindow(100), TimeWindow(100, 50), SessionWindow(100)])
def test_seeds_of_a_windowed_table(spark, window):
    topology = table_of(Table(lambda k, v: k, Agg.sum(), window))
    result = run(topology, {"in": rows(spark, [("k", 1, 1000)]), "table": rows(spark, [("j", 5, 1010)])})
    windows = 2 if window == TimeWindow(100, 50) else 1
    assert sorted(listed(result["table"])) == [("j", 5)] * windows + [("k", 1)] * windows
    again = run(topology, {"in": rows(spark, [("k", 1, 1000)]), "table": result["table"].where("key = 'j'")})
    assert sorted(listed(again["table"])) == [("j", 5)] * windows + [("k", 1)] * windows


def test_too_many_values_of_a_row_are_an_error(spark):
    def topology(n):
        return stream_of(X.transform_values(lambda v: F.sequence(F.lit(1), F.lit(n))))

    data = rows(spark, [("k", 1, 0), ("k", None, 1)])
    assert run(topology(X.FAN_OUT), {"in": data})["out"].select("seq").distinct().count() == 2 * X.FAN_OUT
    with pytest.raises(Exception, match="more than"):
        run(topology(X.FAN_OUT + 1), {"in": data})["out"].collect()


@pytest.mark.parametrize(("key", "value"), [("string", "bigint"), ("bigint", "struct<a:string,b:array<double>>"), ("struct<x:int>", "map<string,boolean>"), ("string", "timestamp")])
def test_text_codec(spark, key, value):
    data = spark.range(5).select(F.expr(f"cast(null as {value})").alias("value"), "id")
    some = {"bigint": "id", "timestamp": "timestamp_millis(id * 1001)", "struct<a:string,b:array<double>>": "named_struct('a', concat('é\"', id), 'b', array(id / 3))", "map<string,boolean>": "map('x', id = 2)"}[value]
    keys = {"string": "concat('k', id)", "bigint": "id", "struct<x:int>": "named_struct('x', cast(id as int))"}[key]
    data = data.select(F.expr(keys).alias("key"), F.when(F.col("id") != 3, F.expr(some)).alias("value"))
    sent = encoded(data)
    assert [f.dataType for f in sent.schema] == [T.StringType()] * 2
    assert sent.where("value is null").count() == 1
    as_bytes = sent.select(F.col("key").cast("binary"), F.col("value").cast("binary"))
    back = decoded(as_bytes, data.schema["key"].dataType, data.schema["value"].dataType)
    assert sorted(map(str, back.collect())) == sorted(map(str, data.collect()))


def test_lookup_tables_are_broadcast_by_rows_and_bytes(spark):
    entities = {"l": Topic("l"), "r": Topic("r"), "a": Stream(), "g": GlobalTable(), "j": Stream(), "out": Topic("out")}
    edges = [("l", "a"), ("r", "g"), ("a", "j"), ("g", "j"), ("j", "out")]
    data = {"l": rows(spark, [("k", 1, 0)]), "r": rows(spark, [("k", 9, 0), ("k", 8, 5), ("j", 2, 0)])}
    hinted = {}
    for name, table in {"fits": GlobalTable(), "rows": GlobalTable(broadcast_rows=1), "bytes": GlobalTable(broadcast_bytes=10), "latest": GlobalTable(broadcast_rows=2)}.items():
        result = run(Topology(edges, entities | {"g": table}, {("a", "g"): Join("left")}), data)
        assert [(k, plain(v)) for k, v in listed(result["out"])] == [("k", (1, 8))]
        hinted[name] = "strategy=broadcast" in result["out"]._jdf.queryExecution().analyzed().toString()
    assert hinted == {"fits": True, "rows": False, "bytes": False, "latest": True}


def test_a_topology_is_shown(tmp_path):
    seen = []
    target = viz.view(table_of(Table()), opener=seen.append)
    assert target.exists() and seen == [target.as_uri()]
