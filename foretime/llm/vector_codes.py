"""Product codes of vectors with integer codebooks.

A component x becomes the integer floor(256 * x). Vectors are cut into PARTS equal consecutive parts; each part
position has a codebook of at most ENTRIES entries, which starts as that part of the rows of the smallest ids. A round
assigns every part to the nearest entry and replaces each entry by the floored mean of its parts; entries without parts
stay. All sums are of 64-bit integers, so the result doesn't depend on how rows are dealt or tasks run again.

The codebooks, ENTRIES * length of a vector numbers, are broadcast; Arrow batches find all distances by
|x|^2 - 2 x.c + |c|^2 in one integer product for each part. A task adds up count and sums by entry, and a grouped
shuffle of PARTS * ENTRIES rows a task merges them.

Cases: rows whose vector is null or holds a null or a number that isn't finite are dropped. Vectors shorter than the
longest, or than the next multiple of PARTS, are as if zeros followed, so an empty vector is all zeros. Integers beyond
`bound` are set to it, which keeps sums exact. A null id comes after all others, rows of one id are ordered by
their vectors, and rows that repeat are all coded. With fewer kept rows than ENTRIES the codebooks have fewer entries.
Labels may be null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, materialise, small

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose distances are found at once.
_BLOCK = 4096


def bound(width: int) -> int:
    """The largest integer of a component: the squared distance of two parts of this width stays below 2 ** 62."""
    return math.isqrt((1 << 60) // max(1, width))


def integers(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """vec_id, label, v array<long>: the kept rows, written as a table, as every round reads them."""
    most = bound(1)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    # the product with SCALE is cut first: a finite component may be beyond any integer
    whole = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return materialise(rows.filter(F.col("x").isNotNull() & F.forall("x", finite)).select("vec_id", "label", F.transform("x", whole).alias("v")), "codes-integers")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as parts: (PARTS, rows, width), filled up with zeros and held within the bound."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < lengths[:, None]] = lists.flatten().to_numpy()
    return np.clip(out, -bound(width), bound(width)).reshape(len(lists), PARTS, width).transpose(1, 0, 2)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of the smallest squared distance to each row, the first of equals, and that distance."""
    distance = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)
    at = distance.argmin(1)
    return at, distance[np.arange(len(part)), at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(at, _BLOCK)


def start(rows: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows of the smallest ids: (PARTS, entries, width). At most `entries` rows come to the driver."""
    first = rows.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.col("vec_id").isNull().alias("no_id"), "v").orderBy("id", "no_id", "v").limit(entries).collect()
    return matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())), width)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total, count = sent.value, np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in _blocks(batches):
            cut = matrix(batch.column(0), width)
            for p in range(parts):
                at = nearest(cut[p], books[p])[0] + p * entries
                count += np.bincount(at, minlength=parts * entries)
                for k in range(width):  # sums of a block stay below 2 ** 53, so they are whole in doubles
                    total[:, k] += np.bincount(at, cut[p][:, k], parts * entries).astype(np.int64)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), *[pa.array(total[used, k]) for k in range(width)]], ["slot", "n", *[f"s{k}" for k in range(width)]])

    columns = [f"s{k}" for k in range(width)]
    each = rows.select("v").mapInArrow(sums, "slot int, n long, " + ", ".join(f"{c} long" for c in columns))
    out = books.reshape(parts * entries, width).copy()
    for r in each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect():  # a row for each entry
        out[r["slot"]] = [r[c] // r["n"] for c in columns]
    sent.unpersist()
    return out.reshape(books.shape)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error: every row by its nearest entries."""
    width, sent = books.shape[2], rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in _blocks(batches):
            cut = matrix(batch.column(2), width)
            codes, error = np.empty((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, book in enumerate(books):
                codes[:, p], distance = nearest(cut[p], book)
                error += distance
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks (PARTS, entries, width) of the integer rows after so many rounds; without rows they have no entries."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // PARTS)
    books = start(rows, width, entries)
    for _ in range(rounds if books.size else 0):
        books = refined(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error of the kept rows, and the codebooks.

    label_error adds up error over the rows of a label; one row for each label meets the rows, broadcast when the labels are
    counted to be few, else in a join whose skewed partitions Spark may split. A sum beyond 64 bits stays at their end.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    rows = integers(vectors, vector, label)
    books = train(rows, rounds, entries)
    if not books.shape[1]:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    out = materialise(coded(rows, books), "codes-rows")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(NO_ID).cast("decimal(38,0)")).cast("long")
    by = materialise(out.groupBy(F.col("label").alias("its_label")).agg(total.alias("label_error")), "codes-labels")
    return out.join(small(by), out["label"].eqNullSafe(by["its_label"])).drop("its_label"), books
