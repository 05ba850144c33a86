"""Topics in storage: Parquet folders, and Kafka where its connector is on the class path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.relation import canonical


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or on a local master a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/weirflow/{uuid.uuid4().hex}"


def read_topic(spark: SparkSession, path: str, *, key: str | Column = "key", value: str | Column = "value", ts: str | Column = "ts", seq: str | Column = "seq") -> DataFrame:
    """A Parquet folder as canonical rows; only the columns asked for are read."""
    return canonical(spark.read.parquet(path), key, value, ts, seq)


def stream_topic(spark: SparkSession, path: str, schema: T.StructType | str, *, key: str | Column = "key", value: str | Column = "value", ts: str | Column = "ts", seq: str | Column = "seq", late: str = "0 seconds", files_per_batch: int | None = None) -> DataFrame:
    """New files of a Parquet folder as canonical rows with a watermark ``late`` behind the latest time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return canonical(reader.parquet(path), key, value, ts, seq).withWatermark("ts", late)


def encoded(df: DataFrame) -> DataFrame:
    """Keys and values of any type as JSON text, for Kafka; a null value is a null (a tombstone)."""
    value = F.when(F.col("value").isNotNull(), F.to_json(F.struct(F.col("value").alias("v"))))
    return df.select(F.to_json(F.struct(F.col("key").alias("k"))).alias("key"), value.alias("value"))


def decoded(df: DataFrame, key: T.DataType, value: T.DataType) -> DataFrame:
    """Key and value back from what ``encoded`` made of them, text or bytes; other columns stay."""
    k = F.from_json(F.col("key").cast("string"), T.StructType([T.StructField("k", key)]))["k"]
    v = F.from_json(F.col("value").cast("string"), T.StructType([T.StructField("v", value)]))["v"]
    return df.withColumns({"key": k, "value": v})


def kafka_topic(spark: SparkSession, servers: str, topic: str, key: T.DataType, value: T.DataType, *, streaming: bool = True, late: str = "0 seconds", **options: str) -> DataFrame:
    """A Kafka topic of ``encoded`` rows; seq is the offset, which orders a key's partition."""
    source = (spark.readStream if streaming else spark.read).format("kafka")
    df = source.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    rows = decoded(df.select("key", "value", F.col("timestamp").alias("ts"), F.col("offset").alias("seq")), key, value)
    return rows.withWatermark("ts", late) if streaming else rows
