"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretime.operators.keyed import replace_partitions


def season_table(df: DataFrame, path: str, season: str = "season") -> None:
    """Replace the seasons that df has; the rows of a season are dealt over files of bounded size."""
    replace_partitions(df.hint("rebalance"), path, [season])


def numeric_scales(df: DataFrame, scales: dict[str, int]) -> DataFrame:
    """Columns rounded half up to the scale they are stored with: only at the write, never before."""
    return df.withColumns({c: F.round(c, s) for c, s in scales.items()})


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.current_timestamp())
