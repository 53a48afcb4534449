"""Keyed writes on plain Parquet: merges are joins or aggregations, replacement is by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: list[str] = []) -> DataFrame:  # noqa: B006
    """old with new's rows in place of those of equal keys; columns of keep_old_if_null keep the old value where the new one is NULL. new has one row for each key."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("__o"))
    n = new.select(*keys, F.struct(*rest).alias("__n"))
    pick = lambda c: F.when(F.col("__n").isNull(), F.col(f"__o.{c}")).otherwise(F.coalesce(F.col(f"__n.{c}"), F.col(f"__o.{c}")) if c in keep_old_if_null else F.col(f"__n.{c}"))
    return o.join(n, keys, "full_outer").select(*keys, *[pick(c).alias(c) for c in rest]).select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks; of equal keys in new one stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest row of each key: one aggregation with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), *[F.col(c) for c in rest if c != ts and not df.schema[c].dataType.typeName() in ("map", "variant")])).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def latest_known(df: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """For each key and value the newest one that isn't NULL."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(ts))).alias(v) for v in values])


def changed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of new whose values differ from old's row of the same key (NULL equals NULL), with the names of what changed; keys that old lacks are left out."""
    o = old.select(*keys, *[F.col(v).alias(f"__old_{v}") for v in values])
    differs = [F.when(~F.col(v).eqNullSafe(F.col(f"__old_{v}")), F.lit(v)) for v in values]
    out = new.join(o, keys).withColumn("changes", F.array_compact(F.array(*differs)))
    return out.filter(F.size("changes") > 0).drop(*[f"__old_{v}" for v in values])


def work_list(items: DataFrame, log: DataFrame, keys: list[str], retry: list[str] = []) -> DataFrame:  # noqa: B006
    """Items not logged yet, or logged with a status of retry."""
    done = log.filter(~F.col("status").isin(retry)) if retry else log
    return items.join(done.select(*keys), keys, "left_anti")


def merge_reports(reports: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key of any report, columns of missing reports NULL: a union and one aggregation instead of a chain of full outer joins."""
    values = [c for r in reports for c in r.columns if c not in keys]
    schema = {f.name: f.dataType for r in reports for f in r.schema.fields}
    same = [r.select(*keys, *[F.col(v) if v in r.columns else F.lit(None).cast(schema[v]).alias(v) for v in values]) for r in reports]
    out = same[0]
    for r in same[1:]:
        out = out.unionByName(r)
    return out.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df over those partitions of the table at path that it has rows for; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key has two rows."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for {twice[0].asDict()}")
