"""Each stage of the pipeline: odd rows, clashing columns, empty tables."""

import random
from collections import Counter

import corpus_pipeline as c
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from weirflow.llm import decontaminate
from weirflow.llm.common import Scratch, released

#: Names that stages use for columns of their own.
CLASHING = ["copy", "n_copies", "lang_pred", "lang_score", "_lang_pred", "has_letter", "fp", "digest", "pool", "rate", "place", "row_no", "part", "k", "h", "w", "ids"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of two made-up languages with null and repeated ids, copies, junk and a benchmark passage; a benchmark."""
    rng = random.Random(51)
    other = ["".join(rng.choice("bcdfgqxz") for _ in range(6)) for _ in range(60)]
    texts = [(prose(rng, rng.randrange(30, 90)), "one") for _ in range(40)] + [(prose(rng, rng.randrange(30, 90), other), "two") for _ in range(40)]
    item = prose(rng, 40)
    rows = [(i, t, lang, rng.choice(["src0", "src1", "src9", None]), len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [(None, prose(rng, 50), None, "src0", 1) for _ in range(3)]  # different texts without an id
    rows += [(7, prose(rng, 50), "one", None, None), rows[3], rows[3], (900, rows[5][1], "one", "src1", None), (901, rows[6][1].upper(), "one", "src1", None)]
    rows += [(902, prose(rng, 30) + " " + item + " " + prose(rng, 20), "one", "src2", 5), (903, item, "one", "src3", 5)]
    rows += [(904, None, "one", "src0", 0), (905, "", "one", "src0", 0), (906, "12 34 !?", "two", "src0", 0), (907, prose(rng, 20_000), "one", "src4", 0)]
    folder = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, prose(rng, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def with_clashes(df):
    return df.withColumns({n: F.concat(F.lit(f"mine {i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for i, n in enumerate(CLASHING)})


def key(r):
    return r["doc_id"], r["text"], r["source"]


@pytest.mark.parametrize(("name", "stage"), c.STAGES)
def test_columns_of_any_name_pass_through(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clashing = with_clashes(docs)
    out = stage(spark, clashing, sf_dir)
    assert out.columns[: len(clashing.columns)] == clashing.columns if name != "sharding" else set(clashing.columns) < set(out.columns)
    got = out.collect()
    assert Counter(map(key, got)) == Counter(map(key, stage(spark, docs, sf_dir).collect()))
    for r in got:
        assert all(r[n] == f"mine {i} {'-' if r['doc_id'] is None else r['doc_id']}" for i, n in enumerate(CLASHING))


@pytest.mark.parametrize(("name", "stage"), c.STAGES)
def test_an_empty_table_stays_empty(spark, sf_dir, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert out.count() == 0
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_what_each_stage_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    named = c.identify(spark, docs, sf_dir)
    gone = Counter(map(key, rows)) - Counter(map(key, named.collect()))
    assert {k[0] for k in gone} == {904, 905, 906}  # without a letter
    kept = Counter(r["text"] for r in c.near_dedup(spark, named, sf_dir).collect())
    texts = {(r["text"] or "").lower() for r in named.collect()}
    assert max(kept.values()) == 1 and {t.lower() for t in kept} == texts  # one of each group of copies, all unrelated texts
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontaminate.overlaps(docs, bench, keys=["doc_id"]).collect()}
    assert dirty == {902, 903}
    clean = c.decontaminated(spark, docs, sf_dir).collect()
    assert Counter(map(key, clean)) == Counter(key(r) for r in rows if r["doc_id"] not in dirty)
    sharded = c.sharded(spark, docs, sf_dir).collect()
    assert Counter(map(key, sharded)) == Counter(map(key, rows))
    sizes = Counter(r["shard"] for r in sharded)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_the_whole_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in c.STAGES:
        docs = Scratch(spark).write(stage(spark, docs, sf_dir))
    assert Counter(map(key, c.run(spark, sf_dir).collect())) == Counter(map(key, docs.collect()))


def test_tables_of_a_stage_are_released(spark):
    outer = Scratch(spark)
    with released():
        inner = Scratch(spark)
        one = inner.write(spark.range(3))
        kept = outer.write(one.selectExpr("id + 1 as id"))
        assert len(inner.paths) == 1
    assert inner.paths == [] and len(outer.paths) == 1
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|no such"):
        spark.read.schema("id long").parquet(one._weirflow_path).count()
