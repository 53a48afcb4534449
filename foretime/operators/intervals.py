"""Intervals [start, end) in whole seconds by key: what they cover, where two sources disagree, and the fewest instants that meet them all.

A sweep is one sorted pass of a key's boundaries; no interval is expanded into its seconds and no pairs are made. Intervals
whose end isn't after their start cover nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretime.operators.sequential import sorted_runs


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end, parts: overlapping and touching intervals of a key as one, and how many went into it."""
    order = Window.partitionBy(*keys).orderBy("__s", "__e")
    rows = df.filter(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
    # an interval opens a new run when it starts after all before it have ended
    opens = F.coalesce(F.col("__s") > F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = rows.withColumn("__opens", opens.cast("long")).withColumn("__run", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "__run").agg(F.min("__s").alias(start), F.max("__e").alias(end), F.count(F.lit(1)).alias("parts")).drop("__run")


def overlaid(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end, in_a, in_b: the stretches between neighbouring boundaries of either source that at least one covers."""

    def edges(df: DataFrame, first: int) -> DataFrame:
        at = lambda c, step: F.struct(F.col(c).alias("__t"), F.lit(step * first).alias("__a"), F.lit(step * (1 - first)).alias("__b"))
        return df.filter(F.col(start) < F.col(end)).select(*keys, F.inline(F.array(at(start, 1), at(end, -1))))

    # boundaries of one instant are added up before the sweep
    steps = edges(a, 1).unionByName(edges(b, 0)).groupBy(*keys, "__t").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    order = Window.partitionBy(*keys).orderBy("__t")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = steps.select(*keys, F.col("__t").alias(start), F.lead("__t").over(order).alias(end), (F.sum("__a").over(so_far) > 0).alias("in_a"), (F.sum("__b").over(so_far) > 0).alias("in_b"))
    return swept.filter("in_a OR in_b")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, both, only_a, only_b: seconds that both sources cover, and those on which they disagree."""
    length = F.col(end) - F.col(start)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, length)), F.lit(0)).cast("long")
    return overlaid(a, b, keys, start, end).groupBy(*keys).agg(total(F.col("in_a") & F.col("in_b")).alias("both"), total(~F.col("in_b")).alias("only_a"), total(~F.col("in_a")).alias("only_b"))


def fewest_instants(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, at, met: the fewest instants of which every closed interval [start, end] holds one, and of how many intervals each is the last one.

    Taken by their ends, an interval that doesn't hold the last instant opens one at its own end; no smaller set meets them all. Of
    intervals with one end those that start last come first: if one of them opens an instant there, all of them hold it.
    The choice is serial within a key: keys run side by side, and each is streamed through one sorted pass.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, met, own = None, 0, None
        for frame in frames:
            out, own = [], tuple(frame.iloc[0][keys])
            for s, e in zip(frame["__s"].tolist(), frame["__e"].tolist()):
                if at is None or s > at:
                    if at is not None:
                        out.append((*own, at, met))
                    at, met = e, 0
                met += 1
            yield pd.DataFrame(out, columns=[*keys, "at", "met"])
        if at is not None:
            yield pd.DataFrame([(*own, at, met)], columns=[*keys, "at", "met"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.filter(F.col(start) <= F.col(end)).select(*keys, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), F.to_json(F.struct(*keys)).alias("__key"))
    rows = rows.withColumn("__late", -F.col("__s"))
    return sorted_runs(rows, "__key", ["__e", "__late"], run, ", ".join(f"{k} {types[k]}" for k in keys) + ", at long, met long")
