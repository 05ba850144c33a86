"""Validation, graph helpers, drawings and physical plans."""

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.functions import xform as X
from weirflow.plans import graph, viz
from weirflow.plans.batch import run
from weirflow.plans.model import Agg, GlobalTable, Join, JoinWindow, Stream, Suppress, Table, TimeWindow, Topic, Topology
from weirflow.plans.validate import TopologyError
from weirflow.queries import chain, joined, stream_of, table_of


def test_graph_helpers():
    edges = [("a", "b"), ("b", "c"), ("b", "d")]
    assert graph.nodes(edges) == ["a", "b", "c", "d"]
    assert graph.leaves(edges) == {"c", "d"}
    assert graph.roots([("a", "c"), ("b", "c")]) == {"a", "b"}
    assert graph.order(edges)[0] == "a"
    assert graph.topics_by_name({"x": Topic("topic-x"), "s": Stream()}) == {"topic-x": Topic("topic-x")}


T = {"a": Topic("a"), "b": Topic("b"), "s": Stream(), "t": Table(), "g": GlobalTable(), "out": Topic("out")}


@pytest.mark.parametrize(
    ("edges", "entities", "joins", "says"),
    [
        ([], {}, {}, "needs an edge"),
        ([("a", "a")], T, {}, "edge to itself"),
        ([("a", "s"), ("s", "a")], T, {}, "cycle"),
        ([("a", "s"), ("a", "s"), ("s", "out")], T, {}, "occurs twice"),
        ([("a", "x"), ("x", "out")], T, {}, "not among the entities"),
        ([("a", "s")], T, {}, "first and last entities are topics"),
        ([("a", "s"), ("b", "s"), ("s", "out")], T, {("a", "b"): Join("inner")}, "need a JoinWindow"),
        ([("a", "t"), ("b", "t"), ("t", "out")], T, {}, "needs a join"),
        ([("a", "g"), ("b", "g"), ("g", "s"), ("b", "s"), ("s", "out")], T, {("b", "g"): Join("left")}, "one source"),
        ([("a", "g"), ("g", "s"), ("s", "out")], T, {}, "can only be joined"),
        ([("a", "t"), ("t", "out")], T | {"t": Table(aggregate=Agg.sum())}, {}, "needs group_by and aggregate"),
        ([("a", "t"), ("t", "out")], T | {"t": Table(lambda k, v: k, Agg.sum(), JoinWindow(1))}, {}, "TimeWindow or a SessionWindow"),
        ([("a", "t"), ("t", "out")], T | {"t": Table(suppress=Suppress())}, {}, "only a windowed table"),
        ([("a", "s"), ("b", "t"), ("s", "j"), ("t", "j"), ("j", "out")], T | {"j": Stream()}, {("s", "t"): Join("outer")}, "no outer join"),
        ([("a", "s"), ("s", "out")], T, {("a", "a"): Join("merge")}, "joins itself"),
    ],
)
def test_findings(edges, entities, joins, says):
    with pytest.raises(TopologyError, match=says):
        Topology(edges, entities, joins).validated()


@pytest.mark.parametrize("bad", [lambda: TimeWindow(0), lambda: TimeWindow(10, 20), lambda: Join("cross"), lambda: Suppress("time_limit")])
def test_bad_parts(bad):
    with pytest.raises(ValueError, match="."):
        bad()


def test_dot(tmp_path):
    topology = joined(Stream(), GlobalTable(), Join("left"))
    text = viz.to_dot(topology)
    assert '"a" -> "j"' in text
    assert "left join" in text
    assert "khaki" in text
    assert "subgraph" not in viz.to_dot(topology, show_joins=False)
    assert viz.save(topology, str(tmp_path / "t.dot")).read_text() == text
    assert "k: 1" in viz.to_dot(topology, rows={"l": [{"key": "k", "value": 1}]})


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    rows(spark, [("k", 1, 0)]).write.parquet(str(tmp_path / "in"))
    df = run(stream_of(X.value_pred(lambda v: v > 3)), {"in": spark.read.parquet(str(tmp_path / "in"))})["out"].select("key")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(value,3)" in plan
    assert "Python" not in plan
    assert "ReadSchema: struct<key:string,value:bigint>" in plan


def test_kept_key_costs_no_second_shuffle(spark, capsys):
    topology = chain({"in": Topic("in"), "t": Table(lambda k, v: k, Agg.sum()), "s": Stream([X.transform_value(lambda v: v + 1)], keep_key=True), "t2": Table(lambda k, v: k, Agg.max()), "out": Topic("out")})
    run(topology, {"in": rows(spark, [("k", 1, 0)])})["out"].explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


@st.composite
def chains(draw):
    """A chain of steps with what each does to a list of (key, value)."""
    return draw(st.lists(st.sampled_from(["inc", "even", "split", "rekey"]), max_size=4)), draw(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5, 5)), max_size=6))


STEPS = {
    "inc": (X.transform_value(lambda v: v + 1), lambda k, v: [(k, v + 1)]),
    "even": (X.value_pred(lambda v: v % 2 == 0), lambda k, v: [(k, v)] if v % 2 == 0 else []),
    "split": (X.flat_map(lambda k, v: [(k, v + 1), (k, v - 1)]), lambda k, v: [(k, v + 1), (k, v - 1)]),
    "rekey": (X.map_kv(lambda k, v: v.cast("string"), lambda k, v: v), lambda k, v: [(str(v), v)]),
}


@settings(max_examples=12, deadline=None)
@given(chains())
def test_random_chains_agree_with_plain_python(spark, drawn):
    names, records = drawn
    expected = list(records)
    for n in names:
        expected = [x for k, v in expected for x in STEPS[n][1](k, v)]
    sums, running = {}, []
    for k, v in expected:
        sums[k] = sums.get(k, 0) + v
        running.append((k, sums[k]))
    topology = chain({"in": Topic("in"), "s": Stream([STEPS[n][0] for n in names]), "t": Table(lambda k, v: k, Agg.sum()), "out": Topic("out")})
    got = run(topology, {"in": rows(spark, [(k, v, 0) for k, v in records])})["out"].orderBy("seq").collect()
    assert [(r["key"], r["value"]) for r in got] == running
    assert dict((r["key"], r["value"]) for r in run(topology, {"in": rows(spark, [(k, v, 0) for k, v in records])}).snapshot("t").collect()) == sums


def test_table_of_table_is_itself(spark):
    r = run(table_of(Table()), {"in": rows(spark, [("k", 1, 0)])}).relations["table"]
    assert r.as_table() is r
    assert r.as_table("other").store == "other"
