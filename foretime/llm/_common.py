"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: such a row sorts after all others.
NO_ID = 2**63 - 1
#: Texts are handed to Python code in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, all of whose tasks see the driver's disk, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foretime-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of the tables written outside of any `released` block by this process, oldest first.
_written: list[str] = []
#: The folders written in the innermost `released` block of this thread.
_block: ContextVar[list[str] | None] = ContextVar("block", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors. `released` removes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foretime/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    block = _block.get()
    (_written if block is None else block).append(path)  # before the write, so that what a failed one leaves is removed too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes in this block are removed at its end, but for the last one, which then belongs to the block around it; if the block fails, all of them. A block sees the tables of its own thread only."""
    outer, own = _block.get(), []
    token = _block.set(own)
    kept: list[str] = []
    try:
        yield
        kept = own[-1:]
    finally:
        _block.reset(token)
        _remove(spark, own[: len(own) - len(kept)])
        (_written if outer is None else outer).extend(kept)


def remove_tables(spark: SparkSession) -> None:
    """Remove the tables that `materialise` wrote outside of blocks, and those that blocks left, when no result that reads them is needed any more."""
    _remove(spark, _written)
    _written.clear()


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text, so that a few very long texts don't add up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # workers go on to other stages


#: Rows of a table of short keys that is broadcast, about 100 bytes each in memory.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, a written table of short keys, with a broadcast hint if it has at most MOST_BROADCAST rows; beyond, Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df
