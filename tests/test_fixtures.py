"""Topologies with literal expectations."""

import pytest
from helpers import listed, rows, timed
from pyspark.sql import functions as F

from weirflow.functions import xform as X
from weirflow.plans.batch import run
from weirflow.plans.model import Agg, GlobalTable, Join, JoinWindow, SessionWindow, Stream, Suppress, Table, TimeWindow, Topic, Topology
from weirflow.plans.workflow import dedupe_entities, with_dedupe
from weirflow.queries import chain, joined, stream_of, table_of

INC = X.transform_value(lambda v: v + 1)
EVEN = X.value_pred(lambda v: v % 2 == 0)


@pytest.mark.parametrize(
    ("topology", "records", "expected"),
    [
        (chain({"in": Topic("in"), "out": Topic("out")}), [("k", 1, 100)], [("k", 1)]),
        (stream_of(INC), [("k", 1, 100)], [("k", 2)]),
        (stream_of(INC, EVEN), [("k", 2, 100), ("k", 3, 150)], [("k", 4)]),
        (table_of(Table()), [("k", 1, 100)], [("k", 1)]),
        (table_of(Table()), [("k", 1, 0), ("k", 2, 50)], [("k", 1), ("k", 2)]),
        (stream_of(X.map_kv(lambda k, v: F.lit("new key"), lambda k, v: v + 1), keep_key=True), [("k", 1, 100)], [("k", 2)]),
        (table_of(Table(lambda k, v: k, Agg.sum())), [("k", 1, 100), ("k", 2, 100)], [("k", 1), ("k", 3)]),
        (stream_of(X.flat_map(lambda k, v: [(k, v + 1), (k, v - 1)])), [("k", 1, 100)], [("k", 2), ("k", 0)]),
        (stream_of(X.transform_values(lambda v: F.array(v - 1, v + 1))), [("k", 1, 100)], [("k", 0), ("k", 2)]),
        (table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100))), [("k", 1, 0), ("k", 2, 50)], [("k", 1), ("k", 3)]),
        (table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100))), [("k", 1, 0), ("k", 2, 500)], [("k", 1), ("k", 2)]),
        (table_of(Table(lambda k, v: v, Agg.sum())), [("k", 1, 0), ("k", 2, 500)], [(1, 1), (2, 2)]),
        (stream_of(X.transform_key(lambda k: F.concat(k, F.lit("b")))), [("a", 1, 0)], [("ab", 1)]),
        (stream_of(X.key_pred(lambda k: k == "a")), [("a", 1, 0), ("b", 2, 1)], [("a", 1)]),
    ],
)
def test_single_input(spark, topology, records, expected):
    assert listed(run(topology, {"in": rows(spark, records)})["out"]) == expected


def test_fan_out(spark):
    topology = Topology([("in", "s"), ("s", "a"), ("s", "b")], {"in": Topic("in"), "s": Stream([INC]), "a": Topic("a"), "b": Topic("b")})
    r = run(topology, {"in": rows(spark, [("k", 1, 100)])})
    assert listed(r["a"]) == listed(r["b"]) == [("k", 2)]


def with_global(how, lookup=None):
    entities = {"l": Topic("l"), "r": Topic("r"), "g": GlobalTable(), "j": Stream(), "out": Topic("out")}
    return Topology([("l", "j"), ("r", "g"), ("g", "j"), ("j", "out")], entities, {("l", "g"): Join(how, lookup=lookup)})


@pytest.mark.parametrize(
    ("topology", "left", "right", "expected"),
    [
        (with_global("inner"), [("k", 1, 100)], [("k", 2, 0)], [("k", (1, 2))]),
        (with_global("left"), [("k", 1, 100), ("k2", 1, 101)], [("k2", 2, 0)], [("k", (1, None)), ("k2", (1, 2))]),
        (with_global("left", lambda k, v: F.concat(k, v.cast("string"))), [("k", 1, 100), ("k2", 1, 101)], [("k1", 2, 0)], [("k", (1, 2)), ("k2", (1, None))]),
    ],
)
def test_global_table(spark, topology, left, right, expected):
    assert listed(run(topology, {"l": rows(spark, left), "r": rows(spark, right)})["out"]) == expected


@pytest.mark.parametrize(
    ("how", "window", "left", "right", "expected"),
    [
        ("left", 100, [("k", 1, 100)], [("k", 2, 150)], [("k", (1, None), 100), ("k", (1, 2), 150)]),
        ("left", 100, [("k", 1, 150)], [("k", 2, 100)], [("k", (1, 2), 150)]),
        ("inner", 100, [("k", 1, 100)], [("k", 2, 150)], [("k", (1, 2), 150)]),
        ("left", 10, [("k", 1, 150)], [("k", 2, 100)], [("k", (1, None), 150)]),
        ("outer", 100, [("k", 1, 100)], [("k", 2, 150)], [("k", (1, None), 100), ("k", (1, 2), 150)]),
        ("outer", 100, [("k", 1, 150)], [("k", 2, 100)], [("k", (None, 2), 100), ("k", (1, 2), 150)]),
        ("outer", 100, [("k", 1, 100)], [("k", 2, 100)], [("k", (1, 2), 100)]),
    ],
)
def test_eager_stream_join(spark, how, window, left, right, expected):
    topology = joined(Stream(), Stream(), Join(how, JoinWindow(window), eager=True))
    got = timed(run(topology, {"l": rows(spark, left), "r": rows(spark, right)})["out"])
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_window_ends_are_included_and_may_differ(spark):
    topology = joined(Stream(), Stream(), Join("inner", JoinWindow(10, 50)))
    r = run(topology, {"l": rows(spark, [("k", 1, 100)]), "r": rows(spark, [("k", 2, 89), ("k", 3, 90), ("k", 4, 150), ("k", 5, 151)])})
    assert listed(r["out"]) == [("k", (1, 3)), ("k", (1, 4))]


def test_final_left_join_waits(spark):
    topology = joined(Stream(), Stream(), Join("left", JoinWindow(100)))
    assert timed(run(topology, {"l": rows(spark, [("k", 1, 100)]), "r": rows(spark, [("k", 2, 150)])})["out"]) == [("k", (1, 2), 150)]


def test_session_gap_of_exactly_the_limit_merges(spark):
    topology = table_of(Table(lambda k, v: k, Agg.count(), SessionWindow(100)))
    got = run(topology, {"in": rows(spark, [("k", 1, 0), ("k", 1, 100), ("k", 1, 201)])}).snapshot("table")
    spans = sorted((r["s"], r["e"], r["value"]) for r in got.select(F.unix_millis("win.start").alias("s"), F.unix_millis("win.end").alias("e"), "value").collect())
    assert spans == [(0, 200, 2), (201, 301, 1)]


def test_hopping_windows_begin_before_the_row_but_not_before_the_epoch(spark):
    topology = table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100, 50)))
    at = lambda ms: sorted(r[0] for r in run(topology, {"in": rows(spark, [("k", 1, ms)])}).snapshot("table").select(F.unix_millis("win.start")).collect())
    assert at(60) == [0, 50]
    assert at(20) == [0]


def test_suppress_shows_the_last_row_of_a_window(spark):
    topology = table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100), Suppress()))
    r = run(topology, {"in": rows(spark, [("k", 1, 0), ("k", 2, 50), ("k", 3, 120)])})
    assert listed(r["out"]) == [("k", 3), ("k", 3)]


def test_suppress_for_a_time(spark):
    topology = table_of(Table(lambda k, v: k, Agg.sum(), suppress=Suppress("time_limit", 100)))
    assert listed(run(topology, {"in": rows(spark, [("k", 1, 0), ("k", 2, 50), ("k", 3, 120)])})["out"]) == [("k", 3), ("k", 6)]


def test_stream_with_table_takes_the_latest_at_its_time(spark):
    topology = joined(Stream(), Table(), Join("left"))
    r = run(topology, {"l": rows(spark, [("k", 1, 10), ("k", 2, 20), ("k", 3, 30)]), "r": rows(spark, [("k", 7, 20), ("k", 8, 25)])})
    assert listed(r["out"]) == [("k", (1, None)), ("k", (2, 7)), ("k", (3, 8))]
    inner = joined(Stream(), Table(), Join("inner"))
    r = run(inner, {"l": rows(spark, [("k", 1, 10), ("k", 2, 20)]), "r": rows(spark, [("k", 7, 20)])})
    assert listed(r["out"]) == [("k", (2, 7))]


@pytest.mark.parametrize(
    ("how", "expected"),
    [
        ("inner", [("k", (1, 7)), ("k", (2, 7))]),
        ("left", [("k", (1, None)), ("k", (1, 7)), ("k", (2, 7))]),
        ("outer", [("k", (1, None)), ("k", (1, 7)), ("k", (2, 7))]),
    ],
)
def test_table_join_updates(spark, how, expected):
    topology = joined(Table(), Table(), Join(how), Table())
    r = run(topology, {"l": rows(spark, [("k", 1, 10), ("k", 2, 30)]), "r": rows(spark, [("k", 7, 20)])})
    assert listed(r["out"]) == expected
    assert listed(r.snapshot("j")) == [("k", (2, 7))]


def test_a_deleted_row_leaves_a_table_join(spark):
    topology = joined(Table(), Table(), Join("inner"), Table())
    r = run(topology, {"l": rows(spark, [("k", 1, 10), ("k", None, 30)]), "r": rows(spark, [("k", 7, 20)])})
    assert listed(r.snapshot("j")) == []


def test_retraction_moves_a_key_between_groups(spark):
    topology = chain({"in": Topic("in"), "t": Table(), "g": Table(lambda k, v: v["g"], Agg.sum(lambda k, v: v["n"])), "out": Topic("out")})
    data = [("u", ("a", 5), 0), ("u", ("b", 7), 10), ("w", ("b", 1), 20)]
    r = run(topology, {"in": rows(spark, data, value="struct<g:string,n:bigint>")})
    assert sorted(listed(r.snapshot("g"))) == [("a", 0), ("b", 8)]
    assert listed(r["out"]) == [("a", 5), ("a", 0), ("b", 7), ("b", 8)]


@pytest.mark.parametrize(("n", "shape"), [(2, (0, 1)), (3, (0, 1, 2)), (4, ((0, 1, 2), 3)), (5, ((0, 1, 2), 3, 4)), (6, (((0, 1, 2), 3, 4), 5))])
def test_shape_of_n_ary_joins(spark, n, shape):
    names = [f"t{i}" for i in range(n)]
    entities = {f"in{i}": Topic(f"in{i}") for i in range(n)} | {x: Table() for x in names} | {"j": Table(), "out": Topic("out")}
    topology = Topology([(f"in{i}", x) for i, x in enumerate(names)] + [(x, "j") for x in names] + [("j", "out")], entities, {tuple(names): Join("inner")})
    r = run(topology, {f"in{i}": rows(spark, [("k", i, 10 * i)]) for i in range(n)})
    assert listed(r.snapshot("j")) == [("k", shape)]


def test_dedupe_keeps_the_first(spark):
    entities, overrides = dedupe_entities("x")
    topology = Topology(with_dedupe("x", "in", "out"), {"in": Topic("in"), "out": Topic("out"), **entities}, overrides=overrides)
    assert listed(run(topology, {"in": rows(spark, [("k", 1, 0), ("k", 1, 10), ("k", 2, 20), ("j", 1, 30)])})["out"]) == [("k", 1), ("k", 2), ("j", 1)]


def test_nulls_are_skipped_in_aggregates(spark):
    topology = table_of(Table(lambda k, v: k, Agg.sum()))
    assert listed(run(topology, {"in": rows(spark, [("k", None, 0), (None, 1, 5), ("k", 2, 10)])})["out"]) == [("k", 2)]


def test_merge_of_more_than_two(spark):
    entities = {n: Topic(n) for n in ("a", "b", "c", "out")} | {"s": Stream()}
    topology = Topology([("a", "s"), ("b", "s"), ("c", "s"), ("s", "out")], entities)
    got = listed(run(topology, {n: rows(spark, [(n, i, i)]) for i, n in enumerate("abc")})["out"])
    assert got == [("a", 0), ("b", 1), ("c", 2)]


def test_results_and_sinks(spark, tmp_path):
    r = run(stream_of(INC), {"in": rows(spark, [("k", 1, 100)])})
    assert {n: len(x) for n, x in r.collect().items()} == {"in": 1, "stream": 1, "out": 1}
    r.write(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
