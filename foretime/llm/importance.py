"""Importance resampling of documents towards a target text collection.

Features of a text are its words and its pairs of neighbouring words, hashed into BUCKETS buckets by CRC-32. A bucket's
gain is the logarithm of how much more frequent it is in the target than in all documents; a document's weight is
the mean gain of its features, and its score adds a Gumbel noise made of its id, so the highest scores are a
draw without replacement in proportion to exp(weight).

Texts are scored as arrays of bytes in Arrow batches: words are found by a table of bytes, their CRCs are advanced for
all words of a batch at once, and the CRC of a pair comes from those of its words, as a CRC is linear. The cutoff
comes from an exact histogram of the whole scores: counts summed from the highest score down tell at which rank each score
begins and where the draw ends. Only rows of scores that are drawn are numbered, by id within their score.

A histogram has a row for each whole score; scores lie within a few times 1000 * ln(number of features), so there are
some hundred thousand of them at any size, and so many counts come to the driver.

Cases: a null text has no words; a text without words has weight 0. Words of any length and very long texts are taken
whole. A null id counts as the id `null` in the noise and comes after all others in ties; rows of one id and one score are
ordered by their number of features. An empty table gives an empty result, an empty target gains that only tell how rare
a bucket is. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import NO_ID, materialise, slices, text_of

BUCKETS = 10_000
#: Documents with at least so many words take part in the draw; it takes this share, in hundredths.
LEAST_WORDS, SHARE, SEED = 20, 25, 7
_POLYNOMIAL = 0xEDB88320
#: Words of up to so many bytes are hashed together, longer ones one by one.
_SHORT = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: letters, digits, and every byte of a sign outside ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


@cache
def _table() -> np.ndarray:
    """The CRC of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(_POLYNOMIAL) ^ (c >> 1), c >> 1)
    return c


@cache
def _shifts() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC turns into when n zero bytes follow, for n up to _SHORT."""
    x = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [x]
    for _ in range(_SHORT):
        x = _table()[x & 255] ^ (x >> 8)
        out.append(x)
    return np.stack(out)


def _after(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs when so many zero bytes follow."""
    t = _shifts()
    return t[lengths, 0, crc & 255] ^ t[lengths, 1, (crc >> 8) & 255] ^ t[lengths, 2, (crc >> 16) & 255] ^ t[lengths, 3, crc >> 24]


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a column of texts, and of each word its text, its first byte and its length."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    raw, offsets = _LOWER[raw], offsets - offsets[0]
    held = _IN_WORD[raw]
    # a word begins where the byte before isn't of a word or belongs to another text
    opens, closes = held.copy(), held.copy()
    opens[1:] &= ~held[:-1]
    closes[:-1] &= ~held[1:]
    inner = offsets[1:-1]
    begin, end = inner[inner < len(raw)], inner[inner > 0] - 1
    opens[begin] = held[begin]
    closes[end] = held[end]
    first = np.flatnonzero(opens)
    return raw, np.searchsorted(offsets, first, "right") - 1, first, np.flatnonzero(closes) + 1 - first


def word_hashes(raw: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word."""
    table, out = _table(), np.empty(len(first), np.uint32)
    for k in np.flatnonzero(lengths > _SHORT):
        out[k] = zlib.crc32(raw[first[k] : first[k] + lengths[k]])
    order = np.argsort(-lengths, kind="stable")
    order = order[np.count_nonzero(lengths > _SHORT) :]
    at, crc = first[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    # words by falling length: those that have a byte at this place stand in front
    left = np.searchsorted(-lengths[order], -np.arange(_SHORT + 1), "left")
    for place in range(_SHORT):
        n = left[place]
        if not n:
            break
        crc[:n] = table[(crc[:n] ^ raw[at[:n] + place]) & 255] ^ (crc[:n] >> 8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: the text and the bucket of each feature (words first, then pairs), and the number of words of each text."""
    raw, text, first, lengths = word_places(column)
    crc = word_hashes(raw, first, lengths)
    pair = np.flatnonzero(text[1:] == text[:-1])
    a, b, n = crc[pair], crc[pair + 1], lengths[pair + 1]
    # CRC-32 turns all bits round before and after: the CRC of x + y is that of x moved on over y, against that of y
    space = _table()[(a ^ 0xFFFFFFFF ^ 32) & 255] ^ ((a ^ np.uint32(0xFFFFFFFF)) >> 8) ^ np.uint32(0xFFFFFFFF)
    both, short = np.empty(len(pair), np.uint32), n <= _SHORT
    both[short] = _after(space[short], n[short]) ^ b[short]
    for k in np.flatnonzero(~short):
        at = first[pair[k] + 1]
        both[k] = zlib.crc32(raw[at : at + n[k]], int(space[k]))
    return np.concatenate([text, text[pair]]), (np.concatenate([crc, both]) % BUCKETS).astype(np.int32), np.bincount(text, minlength=len(column))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the texts lie in each bucket: a task sends a row for each bucket, so many sums come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 0):
            total += np.bincount(features(batch.column(0))[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(text_of().alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln u)) of a u that the id alone decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, bucket, n_words = features(batch.column(1))
            n = np.bincount(text, minlength=batch.num_rows)
            # sums of whole numbers far below 2 ** 53
            total = np.bincount(text, sent.value[bucket], batch.num_rows).astype(np.int64)
            yield pa.record_batch([batch.column(0), *[pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1))]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def cutoffs(histogram: dict[int, int], drawn: int) -> list[tuple[int, int, int]]:
    """(score, rows of higher scores, rows to take) of each score that is drawn, the highest first."""
    out, ahead = [], 0
    for score in sorted(histogram, reverse=True):
        if ahead >= drawn:
            break
        out.append((score, ahead, min(histogram[score], drawn - ahead)))
        ahead += histogram[score]
    return out


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each document; rank is null for those that aren't drawn."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialise(scored.withColumn("eligible", F.col("n_words") >= least_words).drop("n_words"), "importance-scores")
    histogram = {r["score"]: r["n"] for r in scored.filter("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = cutoffs(histogram, share * sum(histogram.values()) // 100)
    no_rank = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not taken:
        return scored.select(*columns, no_rank)
    # a row for each drawn score
    places = F.broadcast(spark.createDataFrame(taken, "score long, ahead long, take long"))
    survives = F.col("eligible") & (F.col("score") >= taken[-1][0])
    order = Window.partitionBy("score").orderBy(F.coalesce("doc_id", F.lit(NO_ID)), F.col("doc_id").isNull(), "n_features")
    numbered = scored.filter(survives).withColumn("place", F.row_number().over(order).cast("long")).join(places, "score")
    drawn = numbered.select(*columns, F.when(F.col("place") <= F.col("take"), F.col("ahead") + F.col("place")).alias("rank"))
    return drawn.unionByName(scored.filter(~survives).select(*columns, no_rank))
