"""Ranks within groups, and ranks over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.sources.shared import written


def average_rank(by: list[str], value: str) -> Column:
    """Rank by falling value where ties share the mean of their ranks; NULL stays NULL."""
    w = Window.partitionBy(*by, F.col(value).isNull()).orderBy(F.col(value).desc())
    peers = Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def rank_share(by: list[str], value: str) -> Column:
    """(average rank - 1) / (n - 1): 0 for the largest, 1 for the smallest; 0 in groups of one."""
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(n > 1, (average_rank(by, value) - 1) / (n - 1)).otherwise(F.when(F.col(value).isNotNull(), F.lit(0.0)))


def share_of_group(by: list[str], value: str) -> Column:
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total > 0, F.col(value) / total)


def whole_row_number(df: DataFrame, order: list[str], name: str = "row_no", count: str | None = None) -> DataFrame:
    """1..n over the whole table in a total order, and n itself under the name count.

    Rows are dealt by ranges of the order, numbered within their range and written; the sizes of the ranges before, one row
    for each partition, are added on reading. The bounds of a range shuffle are sampled anew each time it is planned, so the
    numbers and the sizes must come from one and the same pass.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id holds the partition above bit 33 and the place in the sorted partition below: no further shuffle
    dealt = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "row-numbers")
    dealt = dealt.withColumns({"__part": F.shiftright("__id", 33), "__own": F.col("__id").bitwiseAND((1 << 33) - 1) + 1}).drop("__id")
    sizes = dealt.groupBy("__part").agg(F.max("__own").alias("__n"))
    # one row for each partition of the range shuffle
    before, all_ = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ahead = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"), F.sum("__n").over(all_).alias("__all"))
    out = dealt.join(F.broadcast(ahead), "__part").withColumn(name, (F.col("__own") + F.col("__ahead")).cast("long"))
    return (out.withColumnRenamed("__all", count) if count else out).drop("__own", "__ahead", "__part", "__all")


def equal_count_bins(df: DataFrame, order: list[str], bins: int, name: str = "bin") -> DataFrame:
    """floor((row number - 1) * bins / n): bins of as equal size as can be, ties by the order."""
    numbered = whole_row_number(df, order, "__row", "__rows")
    return numbered.withColumn(name, F.floor((F.col("__row") - 1) * bins / F.col("__rows")).cast("int")).drop("__row", "__rows")


def bit_reversal(index: Column, bits: int) -> Column:
    """The index with its bits in reverse: an order that spreads over the whole range from the start."""
    return F.conv(F.reverse(F.lpad(F.bin(index), bits, "0")), 2, 10).cast("long")
