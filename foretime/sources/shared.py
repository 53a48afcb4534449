"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a step is written: its shuffle files go when it ends, and rows that lie together by some of a join's keys aren't dealt anew.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: Fixed value: a table of up to so many rows (of days, or of games) is broadcast.
SMALL_ROWS = 200_000
#: Fixed value: the rows of players that a task sorts.
ROWS_A_TASK = 250_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master, all of whose tasks see the driver's disk, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foretime-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read twice from it is the same both times, and lost executors cost no lineage. Needs distinct column names."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foretime/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def step(df: DataFrame, name: str) -> DataFrame:
    """df written, with no shuffle file left of it: the disk holds the tables and the shuffles of one step."""
    with _set(df.sparkSession, STEP):
        return written(df, name)


def small_step(df: DataFrame, name: str) -> DataFrame:
    """df as a step; with at most SMALL_ROWS rows, counted, joins broadcast it, so what it meets isn't shuffled. Beyond, Spark decides."""
    out = step(df, name)
    return F.broadcast(out) if _rows(out) <= SMALL_ROWS else out


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A written table dealt by keys, at most about ROWS_A_TASK rows to a task: what a task sorts doesn't grow with the table."""
    n = -(-_rows(table) // ROWS_A_TASK)
    return table.repartition(n, *keys) if n > table.sparkSession.sparkContext.defaultParallelism else table.repartition(*keys)


def _rows(table: DataFrame) -> int:
    with _set(table.sparkSession, STEP):
        return table.count()
