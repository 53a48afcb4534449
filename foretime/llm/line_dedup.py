"""Line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in
lower case; keys under MIN_KEY code points never count. The index holds

- references: a row for each (key, document), the key as its 128-bit hash; from
  it come the exact count of documents and the smallest id (keeper) of a key;
- filters: for each shard of keys a cuckoo filter of the keys that two or more
  documents hold. Cuckoo filters take deletions, so documents can be inserted
  and deleted and the index is as if it had been built of what remains.

A line is dropped if its key is held by two or more documents and the keeper is
another one. The filters answer for nearly all lines that they are in one
document only; just the rest is looked up in the exact table.

Cases: a null or empty text is one empty line, never dropped. A null id counts as
the largest. Rows that repeat an id are one document: their lines don't make
each other go. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, materialise, slices, text_of

MIN_KEY = 10
#: Keys in one cuckoo filter, on average.
SHARD_KEYS = 50_000
#: The filters are sent to all tasks while they are this small together (about 25 million shared keys); beyond it lines meet the exact table directly.
FILTER_BYTES = 64 << 20
SLOTS = 4
_KEYS = "key binary, doc_id long"
_FILTERS = "shard int, slots binary"


def line_key(line: bytes) -> bytes | None:
    """The 128-bit key of a line, or None if it is too short. bytes.strip and bytes.lower treat just the ASCII characters meant here."""
    key = line.strip().lower()
    if len(key) < MIN_KEY or len(key) < 4 * MIN_KEY and len(key.decode("utf-8", "replace")) < MIN_KEY:
        return None
    return xxhash.xxh3_128_digest(key)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, 4 to a bucket; a key is the two halves of a 128-bit hash."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS), a power of two of buckets; 0 is free
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        return words[:, 0], (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def other(self, bucket, mark):
        return (bucket ^ (np.uint64(mark) * np.uint64(0x5BD1E995) if np.isscalar(mark) else mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(self.mask)

    def has(self, keys: list[bytes]) -> np.ndarray:
        first, mark = self.halves(keys)
        a = first & np.uint64(self.mask)
        b = self.other(a, mark)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def insert(self, key: bytes) -> bool:
        first, mark = self.halves([key])
        at, mark = int(first[0]) & self.mask, int(mark[0])
        twin = (at ^ mark * 0x5BD1E995) & self.mask
        for k in range(500):
            for bucket in (at, twin) if not k else (at,):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = mark
                    return True
            out = (mark + k) % SLOTS
            mark, self.slots[at, out] = int(self.slots[at, out]), mark
            at = (at ^ mark * 0x5BD1E995) & self.mask
        return False

    def delete(self, key: bytes) -> None:
        first, mark = self.halves([key])
        at, mark = int(first[0]) & self.mask, int(mark[0])
        for bucket in (at, (at ^ mark * 0x5BD1E995) & self.mask):
            held = np.flatnonzero(self.slots[bucket] == mark)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return


def _filled(keys: list[bytes]) -> Cuckoo:
    room = len(keys)
    while True:
        out = Cuckoo.sized(room)
        if all(map(out.insert, keys)):
            return out
        room = max(8, room * 2)


@dataclass
class LineIndex:
    """references: key, doc_id. shared: key, keeper, holders, for the keys of two or more documents. filters: shard, slots. shards: their number."""

    references: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            found = {line_key(line) for line in text.split(b"\n")}
            found.discard(None)
            keys += found
            ids += [doc_id] * len(found)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"), F.col("doc_id").isNull().alias("no_id"))


def _shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 1] >> np.uint64(20)) % np.uint64(shards)


def _index(references: DataFrame) -> LineIndex:
    """The counts and filters that belong to references."""
    shared = materialise(
        references.groupBy("key")
        .agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
        .filter("keeper < last")
        .drop("last"),
        "line-shared",
    )
    shards = max(1, -(-shared.count() // SHARD_KEYS))
    filters = materialise(_sharded(shared.select("key"), shards).groupBy("shard").applyInPandas(_build, _FILTERS), "line-filters")
    return LineIndex(references, shared, filters, shards)


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(_shard_of(batch.column(0).to_pylist(), shards).astype(np.int32)), batch.column(0)], ["shard", "key"])

    return keys.mapInArrow(mark, "shard int, key binary")


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "slots": [_filled(list(frame["key"])).slots.tobytes()]})


def _loaded(slots: bytes) -> Cuckoo:
    return Cuckoo(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())


def _changed(before: LineIndex, references: DataFrame) -> LineIndex:
    """The index of references, its filters made from those of before by inserting and deleting just the keys that crossed the threshold."""
    after = materialise(
        references.groupBy("key")
        .agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
        .filter("keeper < last")
        .drop("last"),
        "line-shared",
    )
    old, new = before.shared.select("key"), after.select("key")
    gone, come = old.join(new, "key", "left_anti"), new.join(old, "key", "left_anti")
    moves = _sharded(come, before.shards).withColumn("add", F.lit(True)).union(_sharded(gone, before.shards).withColumn("add", F.lit(False)))

    def apply(filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        shard = (filters if len(filters) else moves)["shard"].iloc[0]
        cuckoo = _loaded(filters["slots"].iloc[0]) if len(filters) else Cuckoo.sized(max(8, len(moves)))
        for key in moves.loc[~moves["add"].astype(bool), "key"]:
            cuckoo.delete(key)
        if not all(map(cuckoo.insert, moves.loc[moves["add"].astype(bool), "key"])):
            return pd.DataFrame({"shard": [shard], "slots": [b""]})  # full: made anew below
        return pd.DataFrame({"shard": [shard], "slots": [cuckoo.slots.tobytes()]})

    filters = materialise(before.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(apply, _FILTERS), "line-filters")
    full = filters.filter("length(slots) = 0").select("shard")
    if full.isEmpty():
        return LineIndex(references, after, filters, before.shards)
    anew = _sharded(after.select("key"), before.shards).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, _FILTERS)
    return LineIndex(references, after, materialise(filters.filter("length(slots) > 0").union(anew), "line-filters"), before.shards)


def build_index(docs: DataFrame) -> LineIndex:
    """The index of all lines of docs."""
    return _index(materialise(_source(docs).mapInArrow(_keys, _KEYS), "line-references"))


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """index with docs added. An id that is in the index already must be deleted first."""
    return _changed(index, materialise(index.references.unionByName(_source(docs).mapInArrow(_keys, _KEYS)), "line-references"))


def delete_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """index as if the documents of ids (doc_id) had never been inserted."""
    gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
    return _changed(index, materialise(index.references.join(gone, "doc_id", "left_anti"), "line-references"))


def _candidates(docs: DataFrame, index: LineIndex) -> DataFrame:
    """key, doc_id of the lines of docs that may be shared: as the filters say while they are small, all of them beyond."""
    spark = docs.sparkSession
    size = index.filters.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        return docs.mapInArrow(_keys, _KEYS)
    sent, shards = spark.sparkContext.broadcast({r["shard"]: bytes(r["slots"]) for r in index.filters.collect()}), index.shards

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: _loaded(v) for k, v in sent.value.items()}
        for batch in _keys(batches):
            keys = batch.column(0).to_pylist()
            if not keys:
                continue
            keep, shard = np.zeros(len(keys), bool), _shard_of(keys, shards)
            for k in np.unique(shard):
                at = np.flatnonzero(shard == k)
                if int(k) in filters:
                    keep[at] = filters[int(k)].has([keys[i] for i in at])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(probe, _KEYS)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: a row for each row of docs, by index (that of docs itself by default, or one that holds docs)."""
    index = index or build_index(docs)
    source = _source(docs)
    drops = (
        _candidates(source, index)
        .join(index.shared, "key")
        .filter("keeper < doc_id")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("drops"))
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, dropped, texts = [], [], []
            for text, gone in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                totals.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [x for x in lines if line_key(x) not in gone]
                    text = b"\n".join(lines)
                dropped.append(totals[-1] - len(lines))
                texts.append(text)
            ids = pc.if_else(batch.column(3), pa.scalar(None, pa.int64()), batch.column(0))
            yield pa.record_batch([ids, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return source.join(drops, "doc_id", "left").select("doc_id", "text", "drops", "no_id").mapInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, kept_text string")
