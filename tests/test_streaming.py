"""The same topologies in batch and as streams of one file a batch."""

import pytest
from helpers import rows, timed
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import xform as X
from weirflow.plans.batch import run
from weirflow.plans.model import Agg, GlobalTable, Join, JoinWindow, SessionWindow, Stream, Suppress, Table, TimeWindow, Topic, Topology
from weirflow.plans.workflow import dedupe_entities, with_dedupe
from weirflow.queries import chain, joined, stream_of, table_of
from weirflow.sources.io import stream_topic
from weirflow.streaming import stateful
from weirflow.streaming.compile import StreamTable, compile_streams



def fold():
    return Agg.fold(F.lit(0).cast("long"), lambda acc, k, v: (acc * 31 + v) % 1009)


SUM = StreamTable(0, lambda acc, v: acc + v, T.LongType(), lambda acc, v: acc - v)


class Feed:
    """A folder that gets one file for each batch of records."""

    def __init__(self, spark, path, value="bigint"):
        self.spark, self.path, self.value, self.seq, self.files = spark, str(path), value, 0, 0

    def put(self, *records):
        data = [(k, v, ms, self.seq + i) for i, (k, v, ms) in enumerate(records)]
        df = self.spark.createDataFrame(data, f"key string, value {self.value}, ms bigint, seq bigint")
        df.select("key", "value", F.timestamp_millis("ms").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(self.path)
        self.seq += len(records)
        self.files += 1
        return self

    def stream(self, **options):
        return stream_topic(self.spark, self.path, self.spark.read.parquet(self.path).schema, files_per_batch=1, **options)

    def batch(self):
        return self.spark.read.parquet(self.path)


def streamed(spark, topology, sources, tmp_path, tables=None):
    plan = compile_streams(topology, sources, tables)
    plan.start(str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    plan.await_all()
    return spark.read.schema(next(iter(plan.sinks().values())).schema).parquet(str(tmp_path / "out" / next(iter(plan.sinks()))))


def test_stateless_steps(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0), ("k", 2, 50)).put(("j", 3, 60))
    topology = stream_of(X.transform_value(lambda v: v + 1), X.value_pred(lambda v: v % 2 == 0))
    assert timed(streamed(spark, topology, {"in": feed.stream()}, tmp_path)) == timed(run(topology, {"in": feed.batch()})["out"])


def test_merge_and_fan_in(spark, tmp_path):
    a, b = Feed(spark, tmp_path / "a").put(("k", 1, 0)), Feed(spark, tmp_path / "b").put(("k", 2, 10))
    topology = joined(Stream(), Stream(), Join("merge"))
    assert timed(streamed(spark, topology, {"l": a.stream(), "r": b.stream()}, tmp_path)) == timed(run(topology, {"l": a.batch(), "r": b.batch()})["out"])


@pytest.mark.parametrize("window", [TimeWindow(100), TimeWindow(100, 50), SessionWindow(100)])
def test_windowed_aggregates_close_with_the_watermark(spark, tmp_path, window):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 1000), ("k", 2, 1050), ("j", 7, 1060)).put(("k", 3, 1500)).put(("z", 0, 90_000))
    topology = table_of(Table(lambda k, v: k, Agg.sum(), window, Suppress()))
    got = streamed(spark, topology, {"in": feed.stream()}, tmp_path).groupBy("key").agg(F.sum("value").alias("v")).where("key <> 'z'").collect()
    want = run(topology, {"in": feed.batch()}).snapshot("table").groupBy("key").agg(F.sum("value").alias("v")).where("key <> 'z'").collect()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_stream_join_under_a_watermark(spark, tmp_path, how):
    a = Feed(spark, tmp_path / "a").put(("k", 1, 1000)).put(("k", 2, 5000)).put(("z", 0, 90_000)).put(("z", 1, 180_000))
    b = Feed(spark, tmp_path / "b").put(("k", 8, 1050)).put(("k", 9, 7000)).put(("y", 0, 90_000)).put(("y", 1, 180_000))
    topology = joined(Stream(), Stream(), Join(how, JoinWindow(100)))
    keep = lambda df: [x for x in timed(df) if x[0] == "k"]
    assert keep(streamed(spark, topology, {"l": a.stream(), "r": b.stream()}, tmp_path)) == keep(run(topology, {"l": a.batch(), "r": b.batch()})["out"])


@pytest.mark.parametrize("how", ["left", "outer"])
def test_eager_join_by_state(spark, tmp_path, how):
    feed_a, feed_b = Feed(spark, tmp_path / "a"), Feed(spark, tmp_path / "b")
    feed_a.put(("k", 1, 100), ("k", 2, 300), ("j", 3, 400))
    feed_b.put(("k", 7, 150), ("k", 8, 250), ("j", 9, 400), ("i", 5, 1))
    topology = joined(Stream(), Stream(), Join(how, JoinWindow(60, 80), eager=True))
    assert timed(streamed(spark, topology, {"l": feed_a.stream(), "r": feed_b.stream()}, tmp_path)) == timed(run(topology, {"l": feed_a.batch(), "r": feed_b.batch()})["out"])


def test_running_sum_per_record(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 2, 50), ("k", 1, 0)).put(("j", 5, 60), ("k", 3, 70), ("k", None, 80))
    topology = table_of(Table(lambda k, v: k, Agg.sum()))
    assert timed(streamed(spark, topology, {"in": feed.stream()}, tmp_path, {"table": SUM})) == timed(run(topology, {"in": feed.batch()})["out"])


def test_as_of_join(spark, tmp_path):
    a = Feed(spark, tmp_path / "a").put(("k", 1, 10), ("k", 2, 20), ("k", 3, 30))
    b = Feed(spark, tmp_path / "b").put(("k", 7, 20), ("k", 8, 25))
    topology = joined(Stream(), Table(), Join("left"))
    assert timed(streamed(spark, topology, {"l": a.stream(), "r": b.stream()}, tmp_path)) == timed(run(topology, {"l": a.batch(), "r": b.batch()})["out"])


@pytest.mark.parametrize("how", ["inner", "outer"])
def test_table_join_updates(spark, tmp_path, how):
    a = Feed(spark, tmp_path / "a").put(("k", 1, 10), ("k", 2, 30), ("j", 4, 5))
    b = Feed(spark, tmp_path / "b").put(("k", 7, 20), ("k", 8, 30))
    topology = joined(Table(), Table(), Join(how), Table())
    assert timed(streamed(spark, topology, {"l": a.stream(), "r": b.stream()}, tmp_path)) == timed(run(topology, {"l": a.batch(), "r": b.batch()})["out"])


def test_retraction(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "struct<g:string,n:bigint>").put(("u", ("a", 5), 0)).put(("u", ("b", 7), 10), ("w", ("b", 1), 20))
    topology = chain({"in": Topic("in"), "t": Table(), "g": Table(lambda k, v: v["g"], Agg.sum(lambda k, v: v["n"])), "out": Topic("out")})
    fold = StreamTable(0, lambda acc, v: acc + v["n"], T.LongType(), lambda acc, v: acc - v["n"])
    got = streamed(spark, topology, {"in": feed.stream()}, tmp_path, {"g": fold})
    last = {r["key"]: r["value"] for r in got.orderBy("ts", "seq").collect()}
    assert last == {"a": 0, "b": 8}


def test_lookup_in_a_static_table(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0)).put(("j", 2, 10))
    entities = {"l": Topic("l"), "r": Topic("r"), "a": Stream(), "g": GlobalTable(), "j": Stream(), "out": Topic("out")}
    topology = Topology([("l", "a"), ("r", "g"), ("a", "j"), ("g", "j"), ("j", "out")], entities, {("a", "g"): Join("left")})
    static = rows(spark, [("k", 9, 0)])
    assert timed(streamed(spark, topology, {"l": feed.stream(), "r": static}, tmp_path)) == timed(run(topology, {"l": feed.batch(), "r": static})["out"])


def test_dedupe_and_restart_from_a_checkpoint(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0)).put(("k", 1, 10), ("k", 2, 20))
    entities, overrides = dedupe_entities("x")
    topology = Topology(with_dedupe("x", "in", "out"), {"in": Topic("in"), "out": Topic("out"), **entities}, overrides=overrides)
    first = streamed(spark, topology, {"in": feed.stream()}, tmp_path).count()
    feed.put(("k", 2, 30), ("k", 3, 40))
    got = streamed(spark, topology, {"in": feed.stream()}, tmp_path)
    assert first == 2
    assert sorted(r["value"] for r in got.collect()) == [1, 2, 3]


def test_a_running_table_needs_its_fold(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0))
    with pytest.raises(KeyError, match="StreamTable"):
        compile_streams(table_of(Table(lambda k, v: k, fold())), {"in": feed.stream()})


SEVERAL = Agg.several(n=Agg.count(), total=Agg.sum(), low=Agg.min(), high=Agg.max(), mean=Agg.avg(), last=Agg.latest(), each=Agg.collect())


INITIAL = {"total": 10, "low": -5, "each": [9]}


@pytest.mark.parametrize(("window", "initial"), [(None, None), (None, INITIAL), (TimeWindow(100, 50), None), (SessionWindow(100), INITIAL)])
def test_each_update_of_built_in_aggregates(spark, tmp_path, window, initial):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 10), ("k", 2, 60), ("j", 7, 70)).put(("k", 3, 130), ("k", None, 140)).put(("k", 4, 500), ("k", 0, 510))
    topology = table_of(Table(lambda k, v: k, SEVERAL, window, initial=initial))
    assert timed(streamed(spark, topology, {"in": feed.stream()}, tmp_path)) == timed(run(topology, {"in": feed.batch()})["out"])


@pytest.mark.parametrize("agg", [fold, lambda: SEVERAL, Agg.collect])
def test_closed_windows_of_folds_and_collections(spark, tmp_path, agg):
    feed = Feed(spark, tmp_path / "in").put(("k", 2, 1050), ("k", 1, 1000), ("j", 7, 1060)).put(("k", 3, 1500)).put(("z", 0, 90_000))
    topology = table_of(Table(lambda k, v: k, agg(), TimeWindow(100, 50), Suppress()))
    plain = lambda df: sorted((r["key"], str(r["value"])) for r in df.where("key <> 'z'").collect())
    assert plain(streamed(spark, topology, {"in": feed.stream()}, tmp_path)) == plain(run(topology, {"in": feed.batch()}).snapshot("table"))


def test_hopping_windows_begin_with_the_epoch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 2, 10)).put(("z", 0, 90_000))
    for suppress in (None, Suppress()):
        topology = table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100, 50), suppress))
        out = streamed(spark, topology, {"in": feed.stream()}, tmp_path / str(suppress)).where("key = 'k'")
        assert out.count() == run(topology, {"in": feed.batch()}).snapshot("table").where("key = 'k'").count() == 1


def test_each_update_of_a_windowed_fold(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 2, 10), ("k", 3, 60)).put(("k", 4, 110))
    topology = table_of(Table(lambda k, v: k, fold(), TimeWindow(100)))
    tables = {"table": StreamTable(0, lambda acc, v: (acc * 31 + v) % 1009, T.LongType())}
    assert timed(streamed(spark, topology, {"in": feed.stream()}, tmp_path, tables)) == timed(run(topology, {"in": feed.batch()})["out"])


def test_updates_held_back_for_a_time(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 10), ("k", 2, 60), ("j", 7, 70)).put(("k", 3, 130)).put(("k", 4, 90_000), ("z", 0, 90_000)).put(("z", 0, 190_000))
    topology = table_of(Table(lambda k, v: k, Agg.sum(), None, Suppress("time_limit", 100)))
    keep = lambda df: [x for x in timed(df) if x[0] != "z"]
    assert keep(streamed(spark, topology, {"in": feed.stream()}, tmp_path)) == keep(run(topology, {"in": feed.batch()})["out"])


@pytest.mark.parametrize("flatten", [False, True])
def test_values_of_many_inputs_nest_as_in_batch(spark, tmp_path, flatten):
    feeds = {f"in{i}": Feed(spark, tmp_path / f"in{i}").put(("k", i, 10 * i), ("j", i + 9, 5)) for i in range(4)}
    names = [f"t{i}" for i in range(4)]
    entities = {n: Topic(n) for n in feeds} | {n: Table() for n in names} | {"j": Table(), "out": Topic("out")}
    topology = Topology([*zip(feeds, names, strict=True), *((n, "j") for n in names), ("j", "out")], entities, {tuple(names): Join("inner", flatten=flatten)})
    got = streamed(spark, topology, {n: f.stream() for n, f in feeds.items()}, tmp_path)
    last = {r["key"]: r["value"] for r in got.orderBy("ts", "seq").collect()}
    assert last == {r["key"]: r["value"] for r in run(topology, {n: f.batch() for n, f in feeds.items()}).snapshot("j").collect()}


def test_a_topic_between_is_read_from_storage(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0)).put(("k", 2, 10))
    topology = chain({"in": Topic("in"), "a": Stream([X.transform_value(lambda v: v + 1)]), "mid": Topic("mid"), "b": Stream([X.transform_value(lambda v: v * 10)]), "out": Topic("out")})
    plan = compile_streams(topology, {"in": feed.stream()}, folder=str(tmp_path / "topics"))
    plan.start(checkpoints=str(tmp_path / "ck"), once=True)
    plan.await_all()
    want = run(topology, {"in": feed.batch()})
    for n in ("mid", "out"):
        assert timed(spark.read.parquet(str(tmp_path / "topics" / n))) == timed(want[n])
    plan = plan.frames["out"]._jdf.queryExecution().analyzed().toString()
    assert "topics/mid" in plan


def test_grace_needs_a_watermark_that_is_as_late(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0))
    topology = table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100, grace=5000), Suppress()))
    with pytest.raises(ValueError, match="grace of 5000"):
        compile_streams(topology, {"in": feed.stream(late="1 second")})
    compile_streams(topology, {"in": feed.stream(late="5 seconds")})
    bare = spark.readStream.schema("key string, value long, ts timestamp, seq long").parquet(feed.path)
    plan = compile_streams(topology, {"in": bare})
    assert plan.frames["in"].schema["ts"].metadata["spark.watermarkDelayMs"] == 5000


def test_late_rows_within_the_grace_count(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 50)).put(("k", 2, 4000)).put(("k", 5, 60)).put(("z", 0, 90_000)).put(("z", 0, 190_000))
    bare = spark.readStream.schema("key string, value long, ts timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(feed.path)
    topology = table_of(Table(lambda k, v: k, Agg.sum(), TimeWindow(100, grace=5000), Suppress()))
    got = streamed(spark, topology, {"in": bare}, tmp_path).where("key = 'k'").collect()
    assert sorted(r["value"] for r in got) == [2, 6]


def test_failures_are_told(spark, tmp_path):
    import time

    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0))
    topology = stream_of(X.transform_value(lambda v: F.raise_error(F.lit("no such luck")).cast("long")))
    plan, told = compile_streams(topology, {"in": feed.stream()}), []
    plan.start(str(tmp_path / "out"), str(tmp_path / "ck"), once=True, on_error=lambda name, why: told.append((name, why)))
    with pytest.raises(Exception, match="no such luck"):
        plan.await_all()
    for _ in range(50):
        if told:
            break
        time.sleep(0.2)
    plan.stop()
    assert told and told[0][0] == "out" and "no such luck" in told[0][1]


def test_state_of_silent_keys_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 1, 0)).put(("k", 2, 10))
    topology = table_of(Table(lambda k, v: k, Agg.sum()))
    plan = compile_streams(topology, {"in": feed.stream()}, ttl_ms=3_600_000)
    plan.start(str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    plan.await_all()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "out")).collect()) == [1, 3]


def test_eager_join_forgets_what_the_watermark_has_passed(spark, tmp_path):
    a = Feed(spark, tmp_path / "a").put(("k", 1, 1000)).put(("z", 0, 90_000)).put(("z", 1, 180_000))
    b = Feed(spark, tmp_path / "b").put(("k", 8, 1050)).put(("y", 0, 90_000)).put(("y", 1, 180_000))
    topology = joined(Stream(), Stream(), Join("left", JoinWindow(100), eager=True))
    plan = compile_streams(topology, {"l": a.stream(), "r": b.stream()})
    (query,) = plan.start(str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    plan.await_all()
    assert ("k" in {r["key"] for r in spark.read.parquet(str(tmp_path / "out" / "out")).collect()})
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


@pytest.mark.parametrize("ttl_ms", [None, 3_600_000])
def test_keys_and_windows_share_groups_of_state(spark, tmp_path, monkeypatch, ttl_ms):
    monkeypatch.setattr(stateful, "BUCKETS", 4, raising=False)
    monkeypatch.setattr(stateful, "SLOT", 1000, raising=False)  # so that each batch splits slots
    feed = Feed(spark, tmp_path / "in")
    for batch in range(3):
        feed.put(*((f"k{i % (100 * batch + 100)}", i, batch * 300 + i) for i in range(300)))
    topology = table_of(Table(lambda k, v: k, SEVERAL, TimeWindow(1000)))
    plan = compile_streams(topology, {"in": feed.stream()}, ttl_ms=ttl_ms)
    (query,) = plan.start(str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    plan.await_all()
    assert timed(spark.read.parquet(str(tmp_path / "out" / "out"))) == timed(run(topology, {"in": feed.batch()})["out"])
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 300 / 2  # of 300 keys


class Slots(dict):
    """The map state of a bucket, and how often it was asked and how much was written."""

    def __init__(self):
        self.calls, self.written, self.now = 0, 0, 0

    def getMapState(self, *_):
        return self

    def getValue(self, i):
        self.calls += 1
        return self.get(i)

    def updateValue(self, i, row):
        self.calls, self.written = self.calls + 1, self.written + len(row[0])
        self[i] = row

    def getCurrentProcessingTimeInMs(self):
        return self.now


def bucket(slots, ttl_ms=None):
    """A running sum over the keys of one bucket, a call a batch."""
    import pandas as pd

    def step(state, side, v):
        return (state or 0) + v, [(state or 0) + v]

    keyed = stateful._Keyed(step, ttl_ms)
    keyed.init(slots)

    def put(*records):
        frame = pd.DataFrame([(k, 0, f'{{"v":{v}}}', us, 0) for k, v, us in records], columns=["k", "side", "j", "us", "seq"])
        return [(r.k, r.j) for df in keyed.handleInputRows((0,), iter([frame]), slots) for r in df.itertuples()]

    return put


def test_a_batch_handles_the_slots_of_its_keys_only():
    slots = Slots()
    put = bucket(slots)
    for begin in range(0, 20_000, 5_000):
        put(*((f"key {i}", i, i) for i in range(begin, begin + 5_000)))
    assert slots.calls < 1_000  # of 20,000 keys
    slots.calls = slots.written = 0
    assert put(("key 7", 1, 1), ("key 7", 1, 0)) == [("key 7", '{"v":8}'), ("key 7", '{"v":9}')]
    assert slots.calls <= 4 and slots.written < 3 * stateful.SLOT
    assert sorted(put(*((f"key {i}", 0, i) for i in range(0, 20_000, 11)))) == sorted((f"key {i}", f'{{"v":{i}}}') for i in range(0, 20_000, 11))


def test_silent_keys_go_from_slots_that_others_keep():
    slots = Slots()
    put = bucket(slots, 100)
    put(("a", 1, 0), ("b", 2, 0))
    slots.now = 60
    put(("b", 3, 0))
    slots.now = 100
    assert put(("a", 5, 0), ("b", 5, 0)) == [("a", '{"v":5}'), ("b", '{"v":10}')]


def test_keys_that_went_split_no_slots():
    slots = Slots()
    put = bucket(slots, 100)
    for slots.now in range(0, 40_000, 200):
        put(*((f"key {slots.now + i}", 1, i) for i in range(200)))
    assert len(slots) <= 10


def test_rows_without_time_come_first_as_in_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in").put(("k", 2, 50), ("k", 1, 0), ("k", 4, None))
    topology = table_of(Table(lambda k, v: k, Agg.sum()))
    assert timed(streamed(spark, topology, {"in": feed.stream()}, tmp_path)) == timed(run(topology, {"in": feed.batch()})["out"])
