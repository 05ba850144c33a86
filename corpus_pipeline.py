"""A training corpus from raw documents: five operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, language_id, mixing, queries as operators, sharding, shingles
from weirflow.llm.common import Scratch, free_name, released

#: A text goes if it has no letter, or if no language reaches this probability.
MIN_SCORE = 0.3
#: Near-duplicates share this much of their shingles, of so many words.
MIN_SIMILARITY = 0.8
SHINGLE_WORDS = 5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language identifier rejects."""
    model = language_id.train_language_id(docs.where(~operators.held_out() & F.col("doc_id").isNotNull()))
    lang, score = free_name(docs, "lang_pred", "lang_score")
    judged = language_id.identify_language(docs, model, lang_col=lang, score_col=score)
    return judged.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return shingles.keep_one(docs, words=SHINGLE_WORDS, least=MIN_SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents to the target shares of their sources."""
    copy, copies = free_name(docs, "copy", "n_copies")
    return mixing.mix(docs, operators.MIX_WEIGHTS, other=operators.OTHER_WEIGHT, copy_col=copy, copies_col=copies).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all rows to shards and slots; adds both, the text's size and its CRC-32."""
    return sharding.shard(sharding.sized(docs), operators.SHARDS, ["doc_id", "text_crc32", "size"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Trained models decide the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to shared storage and read again by the next.

    What a stage has written for itself, and what it has read, goes as soon as its result is there.
    """
    scratch = Scratch(spark)
    docs = operators.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with released():
            result = scratch.write(stage(spark, docs, sf_dir))
        if scratch.paths[:-1]:
            scratch.drop(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
