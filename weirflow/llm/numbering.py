"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import Scratch, free_name

#: monotonically_increasing_id has the partition above these bits and the place in it below.
PLACE_BITS = 33


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """``df`` with a gapless number from 0 in ascending ``order`` (nulls first), and how many rows there are.

    Rows are range-partitioned, sorted and written once with their partition and place in it; a table of one row
    per partition then gives each partition its first number.  Rows that tie on ``order`` share a partition and are
    numbered in any order, which is harmless when they are equal.
    """
    scratch = Scratch(df.sparkSession)
    (place,) = free_name(df, "place")
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = scratch.write(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, PLACE_BITS)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    first, total = [], 0
    for number, count in sizes:
        first.append((number, total))
        total += count
    if not first:
        return placed.drop(place).withColumn(name, F.lit(0).cast("long")), 0
    own, start = free_name(placed, "part", "first_no")
    starts = df.sparkSession.createDataFrame(first, f"`{own}` long, `{start}` long")
    joined = placed.withColumn(own, part).join(F.broadcast(starts), own)  # one row for each range partition
    row = F.col(start) + F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return joined.withColumn(name, row).drop(own, start, place), total
