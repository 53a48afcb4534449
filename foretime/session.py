"""The session the library is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, and adaptive execution, which sizes shuffles and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "foretime", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; settings (dots as double underscores) come on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
