"""Mixing sources to target weights by Poisson replication.

A source whose share of the corpus bytes is below its target share is repeated,
one above it thinned.  The mean repetition rate of a source is its share of the
wanted bytes over the bytes it has; each document's count is a Poisson variable
of that mean, drawn by inverting the distribution at a uniform number hashed
from the document's key and text and a seed; copies are exploded and dealt to
partitions by a second hash, sorted by a third: a global shuffle that any rerun
repeats.  As the text is hashed too, rows of one hot key (null, say) draw apart
and spread over all partitions.

Large means are split into equal parts of at most PART each, every part drawn
by its own hash, so no power underflows and work follows the rows put out.

Only DataFrame functions run; nothing is collected.

Defined cases: sources outside the weights, null included, share the weight
``other`` as one pool; a pool without bytes, or with weight 0, has no rows out;
null and empty texts count EMPTY_BYTES bytes, and draw apart from each other;
repeated rows, of one key and text, draw equal counts and have equal places;
very long texts are one document as any other; an empty table gives no rows.
An input column named like an output is replaced; any other name may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import free_name

#: Largest mean that is inverted at once, and entries of its cumulative table; the mass beyond them is under 2**-53.
PART = 16.0
ENTRIES = 72
EMPTY_BYTES = 1
MAX_SOURCES = 10_000


def unit_hash(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an MD5 over the parts."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") * F.lit(2.0**-52)


def source_rates(docs: DataFrame, weights: dict[str, float], other: float, text: str, source: str, epochs: float) -> DataFrame:
    """Pool, mean rate, parts and each part's cumulative Poisson table: at most one row for each weight and one for the rest."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources can have a weight")
    bytes_of = F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(EMPTY_BYTES)).cast("long")
    held = docs.groupBy(pool(source, weights).alias("pool")).agg(F.sum(bytes_of).alias("pool_bytes"))
    known = F.create_map(*(F.lit(x) for name, weight in weights.items() for x in (name, float(weight)))) if weights else None
    target = F.lit(float(other)) if known is None else F.coalesce(known[F.col("pool")], F.lit(float(other)))
    held = held.withColumn("weight", target)
    whole = Window.partitionBy(F.lit(0))  # over one row for each weight
    held = held.withColumns({"all_bytes": F.sum("pool_bytes").over(whole), "all_weight": F.sum("weight").over(whole)})
    rate = F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * F.col("all_bytes") / F.col("pool_bytes")
    rates = held.where("all_weight > 0").withColumn("rate", rate)
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all"))

    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return rates.select("pool", "rate", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES)), start, grow, lambda acc: acc["all"]).alias("cumulative"))


def pool(source: str, weights: dict[str, float]) -> Column:
    """The source if it has a weight of its own, else the null-safe name of the rest."""
    return F.when(F.col(source).isin(*weights), F.col(source)).otherwise(F.lit("")) if weights else F.lit("")


def mix(docs: DataFrame, weights: dict[str, float], *, other: float = 0.0, epochs: float = 1.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", copy_col: str = "copy", copies_col: str = "n_copies", spread: int | None = None) -> DataFrame:
    """Each document as often as drawn, in globally shuffled order, with its copy number from 0 and its count.

    ``weights`` are relative target shares in bytes; ``epochs`` is the wanted output over the input, in bytes.
    Counts and places are hashed from the key and the text's digest.
    """
    if "" in weights:
        raise ValueError("a source with a weight needs a name")
    kept = docs.drop(*(c for c in docs.columns if c.lower() in (copy_col.lower(), copies_col.lower())))
    names = kept.columns
    p, rate, parts, table, place, digest = free_name(kept, "pool", "rate", "parts", "cumulative", "place", "digest")
    own = [F.col(key), F.col(digest)]
    rates = source_rates(kept, weights, other, text, source, epochs).toDF(p, rate, parts, table)
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)),
        F.lit(0),
        lambda acc, part: acc + F.size(F.filter(F.col(table), lambda c: c <= unit_hash(F.lit(seed), *own, part))),
    )
    one = F.size(F.filter(F.col(table), lambda c: c <= F.col(place)))
    drawn = (
        kept.withColumns({p: pool(source, weights), digest: F.md5(F.col(text).cast("binary"))})
        .join(F.broadcast(rates), p)  # bounded by the weights
        .withColumn(place, unit_hash(F.lit(seed), *own, F.lit(1)))
        .withColumn(copies_col, F.when(F.col(parts) == 1, one).otherwise(draw).cast("int"))
        .where(F.col(copies_col) > 0)
        .select(*names, digest, copies_col, F.explode(F.sequence(F.lit(0), F.col(copies_col) - 1)).alias(copy_col))
        .withColumn(place, F.xxhash64(F.lit(seed), *own, F.col(copy_col)))
    )
    by = F.xxhash64(F.col(place), F.lit(seed))
    dealt = drawn.repartition(spread, by) if spread else drawn.repartition(by)
    return dealt.sortWithinPartitions(place).drop(place, digest)
