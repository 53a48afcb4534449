"""Interval, range and name joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretime.functions.text import initial_and_surname, plain_name


def contained(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: float) -> DataFrame:
    """points that lie in some interval [lo, hi) of their keys, or at lo of an empty one.

    Intervals are put into the buckets of width they touch, so the join has equal keys (keys, bucket) beside the range.
    """
    i = intervals.select(*keys, F.col(lo).alias("__lo"), F.col(hi).alias("__hi")).withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    inside = ((F.col(at) >= F.col("__lo")) & (F.col(at) < F.col("__hi"))) | (F.col(at) == F.col("__lo"))
    return p.join(i, _equal(p, i, [*keys, "__b"]) & inside, "left_semi").drop("__b")


def _equal(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def closest_day(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, right_id: str, most: int = 1) -> DataFrame:
    """left with right_id of the only right row at the smallest distance of days, up to most; NULL if there is none or more than one."""
    r = right.select(*keys, F.col(right_id).alias("__id"), F.explode(F.array(*[F.date_add(right_date, d) for d in range(-most, most + 1)])).alias("__day"), F.col(right_date).alias("__date"))
    # what is closest depends on the keys and the day alone
    near = left.select(*keys, F.col(left_date).alias("__day")).distinct().join(r, [*keys, "__day"]).withColumn("__gap", F.abs(F.datediff("__day", "__date")))
    best = near.groupBy(*keys, "__day", "__gap").agg(F.min("__id").alias("__low"), F.max("__id").alias("__high")).groupBy(*keys, "__day").agg(F.min(F.struct("__gap", "__low", "__high")).alias("b"))
    picked = best.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__day", F.when(F.col("b.__low") == F.col("b.__high"), F.col("b.__low")).alias(right_id))
    same = left[left_date].eqNullSafe(picked["__day"])
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(picked[f"__k{i}"])
    return left.join(picked, same, "left").drop("__day", *[f"__k{i}" for i in range(len(keys))])


def resolve_names(mentions: DataFrame, people: DataFrame, name: str, team: str, person_id: str) -> DataFrame:
    """mentions with person_id: by whole plain name, then by first initial and surname, then by a surname that one person of the team has.

    Each tier takes a name only if one person answers to it, on the mention's team if several do elsewhere; ambiguous names stay NULL.
    """
    p = people.select(F.col(person_id).alias("__id"), F.col(team).alias("__team"), plain_name(F.col(name)).alias("__name")).withColumn("__short", initial_and_surname(F.col("__name"))).distinct()
    keys = p.select("__id", "__team", F.inline(F.array(
        F.struct(F.lit(0).alias("tier"), F.col("__name").alias("key")),
        F.struct(F.lit(1).alias("tier"), F.concat_ws("|", "__short.initial", "__short.surname").alias("key")),
        F.struct(F.lit(2).alias("tier"), F.concat_ws("|", "__team", "__short.surname").alias("key")),
    )))
    anywhere = keys.filter("tier < 2").groupBy("tier", "key").agg(F.min("__id").alias("id"), F.count_distinct("__id").alias("n")).filter("n = 1").select("tier", "key", "id", F.lit(1).alias("rank"))
    on_team = keys.withColumn("key", F.when(F.col("tier") < 2, F.concat_ws("|", "__team", "key")).otherwise(F.col("key"))).groupBy("tier", "key").agg(F.min("__id").alias("id"), F.count_distinct("__id").alias("n")).filter("n = 1").select("tier", "key", "id", F.lit(0).alias("rank"))
    index = anywhere.unionByName(on_team)
    m = mentions.withColumn("__name", plain_name(F.col(name))).withColumn("__short", initial_and_surname(F.col(name)))
    tries = lambda team: F.array(
        F.struct(F.lit(0).alias("tier"), F.lit(0).alias("rank"), F.concat_ws("|", team, "__name").alias("key")),
        F.struct(F.lit(0).alias("tier"), F.lit(1).alias("rank"), F.col("__name").alias("key")),
        F.struct(F.lit(1).alias("tier"), F.lit(0).alias("rank"), F.concat_ws("|", team, "__short.initial", "__short.surname").alias("key")),
        F.struct(F.lit(1).alias("tier"), F.lit(1).alias("rank"), F.concat_ws("|", "__short.initial", "__short.surname").alias("key")),
        F.struct(F.lit(2).alias("tier"), F.lit(0).alias("rank"), F.concat_ws("|", team, "__short.surname").alias("key")),
    )
    names = m.select("__name", F.col(team).alias("__of"), "__short").distinct()
    names = names.select("__name", "__of", F.inline(tries(F.col("__of"))))
    found = names.join(index, ["tier", "rank", "key"]).groupBy(F.col("__name").alias("__who"), "__of").agg(F.min_by("id", F.struct("tier", "rank")).alias(person_id))
    return m.join(found, m["__name"].eqNullSafe(found["__who"]) & m[team].eqNullSafe(found["__of"]), "left").drop("__name", "__short", "__who", "__of")
