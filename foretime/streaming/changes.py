"""Streams of snapshots: late rows, changes, and state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def snapshots(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet snapshots; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def before_start(df: DataFrame, ts: str, starts: DataFrame, key: str, start: str) -> DataFrame:
    """Rows strictly before their item's start: rows that come late change nothing after it."""
    return df.join(starts.select(key, start), key).filter(F.col(ts) < F.col(start))


def windowed(df: DataFrame, ts: str, late: str, length: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """n and total for each event-time window; state of windows older than the watermark is dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    w = F.session_window(ts, gap)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def changes(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Batch form: the rows whose values differ from the row of their key before (NULL equals NULL); the first row of a key counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.lag(F.lit(1)).over(w).isNull()
    differs = first
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return df.withColumn("__changed", differs).filter("__changed").drop("__changed")


def store_on_change(df: DataFrame, key: str, ts: str, digest: str) -> DataFrame:
    """Stream form: rows of a key whose digest differs from the last stored one. Rows of a batch are taken in order of ts; rows older than the stored one are late and go."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = f"{key} {types[key]}, {ts} timestamp, {digest} string"

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values([ts, digest])  # of one key and one trigger
        kept = []
        for t, d in zip(rows[ts], rows[digest]):
            if (at is None or t.value > at) and d != last:
                kept.append((keys[0], t, d))
                last, at = d, t.value
        if kept:
            state.update((last, at))
        yield pd.DataFrame(kept, columns=[key, ts, digest])

    return df.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(digest).cast("string").alias(digest)).groupBy(key).applyInPandasWithState(run, out, "last string, at long", "append", GroupStateTimeout.NoTimeout)


def set_changes(df: DataFrame, key: str, ts: str, members: str) -> DataFrame:
    """Stream form: key, ts, added, removed for each snapshot of a key's set that differs from the one before; the first snapshot is the baseline and makes no event."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = f"{key} {types[key]}, {ts} timestamp, added array<string>, removed array<string>"

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had, at = (set(state.get[0]), state.get[1]) if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(ts)
        events = []
        for t, now in zip(rows[ts], rows[members]):
            if at is not None and t.value <= at:
                continue
            now, at = set(now), t.value
            if had is not None and now != had:
                events.append((keys[0], t, sorted(now - had), sorted(had - now)))
            had = now
        if had is not None:
            state.update((sorted(had), at))
        yield pd.DataFrame(events, columns=[key, ts, "added", "removed"])

    return df.groupBy(key).applyInPandasWithState(run, out, "had array<string>, at long", "append", GroupStateTimeout.NoTimeout)


def snapshot_diff(before: DataFrame, now: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Batch form for two snapshots: keys, event (added, removed, changed), old and new status: one full outer join."""
    b, n = before.select(*keys, F.col(status).alias("old"), F.lit(1).alias("__b")), now.select(*keys, F.col(status).alias("new"), F.lit(1).alias("__n"))
    event = F.when(F.col("__b").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return b.join(n, keys, "full_outer").withColumn("event", event).filter("event IS NOT NULL").drop("__b", "__n")


def freshness(df: DataFrame, keys: list[str], order: list[str], ts: str, values: list[str]) -> DataFrame:
    """For each series: snapshots, changes (the first not counted) and when it last changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    moved = differs & F.lag(F.lit(1)).over(w).isNotNull()
    return df.withColumn("__moved", moved).groupBy(*keys).agg(F.count(F.lit(1)).alias("snapshots"), F.count_if("__moved").alias("changes"), F.max(F.when(F.col("__moved"), F.col(ts))).alias("last_change"))


def due(starts: DataFrame, last: DataFrame, key: str, start: str, ts: str, now: str, lead: str, gap: str) -> DataFrame:
    """Items that start in (now, now + lead] and whose last capture is gap old or missing."""
    t = F.lit(now).cast("timestamp")
    soon = (F.col(start) > t) & (F.col(start) <= t + F.expr(f"INTERVAL {lead}"))
    return starts.filter(soon).join(last.select(key, ts), key, "left").filter(F.col(ts).isNull() | (F.col(ts) <= t - F.expr(f"INTERVAL {gap}")))


def write_idempotent(df: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch as its own partition, overwritten if it is tried again; stops when the source is drained."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """For each key, of pairs (status, points, cents): how many are paired and identical, their mean and largest gap in points, mean gap in cents, and those unpaired or at another line."""
    ok = (F.col("status") == "ok") & F.col("points").isNotNull()
    of = lambda c: F.when(ok, F.abs(c))
    return pairs.groupBy(*keys).agg(
        F.count_if(ok).alias("paired"), F.count_if(ok & (F.col("cents") == 0)).alias("identical"), F.avg(of("points")).alias("mean_points"), F.max(of("points")).alias("max_points"), F.avg(of("cents")).alias("mean_cents"),
        F.count_if(F.col("status") == "unpaired").alias("unpaired"), F.count_if(F.col("status") == "line_differs").alias("line_differs"),
    )


def freshness_summary(series: DataFrame, keys: list[str]) -> DataFrame:
    """For each key, of series (snapshots, changes): how many, their snapshots and changes, and how many moved at all."""
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("series"), F.sum("snapshots").alias("snapshots"), F.sum("changes").alias("changes"), F.count_if(F.col("changes") > 0).alias("moved"))


def run_due(now: Column, opens: Column, last_start: Column, last_run: Column, gap: str = "14 minutes") -> Column:
    """Whether a scheduled run should work: a day with starts, from its opening to its last start, at most once in gap."""
    rested = last_run.isNull() | (now >= last_run + F.expr(f"INTERVAL {gap}"))
    return F.coalesce((now >= opens) & (now <= last_start) & rested, F.lit(False))


def lineup_changes(before: DataFrame, now: DataFrame, team: str, unit: str, member: str) -> DataFrame:
    """team, event, what: members of one snapshot alone (OUT, IN), and units whose set of members differs (UNIT). Teams without an earlier snapshot make no event."""
    seen = before.select(team).distinct()
    now = now.join(seen, team, "left_semi")
    b, n = (x.select(team, member).distinct() for x in (before, now))
    moved = b.join(n, [team, member], "left_anti").select(team, F.lit("OUT").alias("event"), F.col(member).alias("what")).unionByName(n.join(b, [team, member], "left_anti").select(team, F.lit("IN").alias("event"), F.col(member).alias("what")))
    units = lambda x, name: x.groupBy(team, unit).agg(F.sort_array(F.collect_set(member)).alias(name))  # noqa: E731  a unit has a few members
    present = now.select(team).distinct()
    changed = units(before.join(present, team, "left_semi"), "was").join(units(now, "is"), [team, unit], "full_outer").filter(~F.col("was").eqNullSafe(F.col("is")))
    return moved.unionByName(changed.select(team, F.lit("UNIT").alias("event"), F.col(unit).alias("what")))
