"""Division and missing values: NULL means unknown and is never zero; NaN stops at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """scale * num / den; NULL where den is NULL or not positive."""
    return F.when(den > 0, num * F.lit(scale) / den)


def per60(stat: Column, seconds: Column) -> Column:
    """A count per hour of play."""
    return ratio(stat, seconds, 3600.0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def known(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """The boundary of a source: no NaN in any floating column."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c, t in df.dtypes if t in ("double", "float")})


def both_or_neither(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """If one of two columns is NULL, the other becomes NULL too."""
    out = df
    for a, b in pairs:
        gap = F.col(a).isNull() | F.col(b).isNull()
        out = out.withColumns({a: F.when(~gap, F.col(a)), b: F.when(~gap, F.col(b))})
    return out


def stage_of(number: Column, early: int = 20, mid: int = 62) -> Column:
    """EARLY up to early, MID up to mid, LATE beyond; numbers under 1 are an error."""
    return (
        F.when(number < 1, F.raise_error(F.lit("the number must be 1 or more")).cast("string"))
        .when(number <= early, "EARLY")
        .when(number <= mid, "MID")
        .when(number.isNotNull(), "LATE")
    )
