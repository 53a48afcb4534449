"""Two-sided rows, wide and long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(df: DataFrame, common: list[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """A row for each side: common columns, is_home, and the columns that home and away map to the same names. One scan: the sides are exploded, not unioned."""
    side = lambda names, at_home: F.struct(F.lit(at_home).alias("is_home"), *[F.col(c).alias(n) for n, c in names.items()])
    return df.select(*common, F.inline(F.array(side(home, True), side(away, False))))


def pair_sides(df: DataFrame, keys: list[str], is_home: str, values: list[str]) -> DataFrame:
    """The inverse: home_{v} and away_{v} for each key; one aggregation, no self join."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(is_home) == at, F.col(v))).alias(f"{p}_{v}") for v in values for at, p in ((True, "home"), (False, "away"))])


def two_sided(df: DataFrame, keys: list[str], side: str, names: list[str], value: str, ts: str) -> DataFrame:
    """One column for each side's latest value; keys that lack a side go."""
    wide = df.groupBy(*keys).agg(*[F.max_by(value, F.when(F.col(side) == n, F.col(ts))).alias(n) for n in names])
    return wide.dropna(subset=names)


def widen(df: DataFrame, keys: list[str], by: str, values: list, columns: list[str]) -> DataFrame:
    """{column}_{value} for each listed value of by: a pivot whose values are given, so no extra job looks for them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(by) == F.lit(v), F.col(c))).alias(f"{c}_{v}") for v in values for c in columns])


def lengthen(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])))


def differences(df: DataFrame, names: list[str]) -> DataFrame:
    """{n}_diff: home minus away, 0 where either is unknown."""
    return df.withColumns({f"{n}_diff": F.coalesce(F.col(f"home_{n}") - F.col(f"away_{n}"), F.lit(0.0)) for n in names})


def vector(columns: list[str]) -> Column:
    """A dense array in the given order; an unknown, NaN or infinite entry is an error."""
    out = F.array(*[F.col(c).cast("double") for c in columns])
    bad = F.exists(out, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.when(bad, F.raise_error(F.lit("the vector has an entry that isn't finite")).cast("array<double>")).otherwise(out)
