"""Small inputs and comparisons for topology tests."""

from pyspark.sql import functions as F


def rows(spark, records, key="string", value="bigint"):
    """Records (key, value, epoch ms) in order of arrival."""
    data = [(k, v, ms, i) for i, (k, v, ms) in enumerate(records)]
    df = spark.createDataFrame(data, f"key {key}, value {value}, ms bigint, seq bigint")
    return df.select("key", "value", F.timestamp_millis("ms").alias("ts"), "seq")


def plain(v):
    return tuple(plain(x) for x in v) if hasattr(v, "__fields__") else v


def listed(df, *order):
    """(key, value) in order of time."""
    return [(r["key"], plain(r["value"])) for r in df.orderBy(*(order or ("ts", "seq"))).collect()]


def timed(df):
    return sorted(((r["key"], plain(r["value"]), r["ms"]) for r in df.select("key", "value", F.unix_millis("ts").alias("ms")).collect()), key=str)
