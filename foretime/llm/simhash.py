"""SimHash near-dedup with BK-trees.

A text is lower-cased (A-Z), cut into words `[^\\x20\\x09-\\x0D]+` and w-word shingles
joined by a space, repeats included (fewer words: the whole sequence). A bit of
the fingerprint is 1 if it is set in over half of the shingles' hashes; without words
it is zero. Fingerprints within a Hamming radius link, and the
documents of a connected component are one group.

Search. Equal fingerprints are one node first, so copies cost nothing. Every node is
put under several keys, each a subset of the bits: nodes under one key form a shard,
and a BK-tree over the shard (children keyed by their distance to the parent; a search
follows the edges within the radius alone) finds who links. The bits are cut into bands
and the keys are combinations of bands, so that two nodes within the radius share at
least one key: the search is exact for every radius and number of nodes. How many bands
there are follows the number of nodes, so that shards stay small where few keys allow it;
with a wide radius shards are large and their parts many.
A shard of over SHARD nodes is dealt into parts, a tree over every two parts, so no
tree has over about 2 * SHARD nodes, however large a group, and no pair is missed.
A tree gives links that connect what it holds, not all pairs.

`drop_near_duplicates` links two texts when their fingerprints are within the radius and
their sets of shingles have a Jaccard similarity of SIMILAR or more, compared on the whole
texts. At that similarity 155 of 1,024 bits differ on average, with a deviation of about 11.5, so the radius of 176 takes
in 96 of 100 pairs at exactly 0.8, nearly all from 0.82 on, and few under 0.75. Texts meet under the smallest
hashes of their shingles: a pair of similarity 0.8 or more shares one of the smallest (1 - SIMILAR) * size + 1 of each, and,
as eight in nine of the hashes of one are the other's too, one of the SEEDS smallest but for about two pairs in a million; neither
chance depends on the number of texts. With `seeds=None` texts meet under all of these hashes and with a radius of all bits every
pair that meets is compared: then no pair is missed. Who of a shard is within the radius is found by its BK-tree, here
with all searches of a shard going down the tree together: at a radius as wide as this the edges of texts that have nothing in common
are followed, and what is skipped are the near copies of a node that is far away. Candidates
differ little enough in size, too. They are compared in rounds, a few for each text of a shard first;
pairs that are in one group by then need no comparison, so a dense group costs few, and only shards that had more go on.

Cases: a null or empty text has fingerprint zero and links like any other. A null id
counts as the largest id and comes back as null. Rows that repeat are linked. An
empty table gives an empty result. Other columns are ignored by `near_groups` and
carried along by `drop_near_duplicates`, which tells rows by id and text: other texts
under the same id, or without an id, stay.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NO_ID, materialise, released, slices, small, text_of
from ._components import components

#: Nodes in one part of a shard.
SHARD = 4096
#: Keys of a node.
MOST_KEYS = 500
#: Least Jaccard similarity of the shingle sets of near copies, as a fraction.
SIMILAR = (4, 5)
#: Hashes under which a text meets others, at most.
SEEDS = 6
#: Fills prefixes up to the longest.
NO_HASH = -(2**63)
#: Pairs of whole texts handed to Python at once.
PAIRS = 64
#: Candidates for each text of a shard in the first round, and how many times more in each next one.
FEW, MORE = 16, 64


@dataclass(frozen=True)
class Params:
    words: int = 5
    bits: int = 1024  # 64: XXH64; more: words mixed from XXH3's 128 bits
    radius: int = 176
    seed: int = 42


#: Five-word shingles, and a radius that takes in nearly all pairs of similarity 0.8 or more, and few others.
NEAR = Params()


def _digests(words: list[bytes], p: Params) -> Iterator[np.ndarray]:
    """The hashes of all shingles, a row of bytes for each, in slices."""
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - p.words + 1)
    digest = partial(xxhash.xxh64_digest if p.bits == 64 else xxhash.xxh3_128_digest, seed=p.seed)
    for at in range(0, n, 1 << 14):
        first = starts[at : min(n, at + (1 << 14))]
        last = starts[at + min(p.words, len(words)) :][: len(first)]
        hashes = b"".join([digest(joined[a : b - 1]) for a, b in zip(first, last)])
        yield np.frombuffer(hashes, np.uint8).reshape(len(first), -1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit depends on all bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _widened(x: np.ndarray, bits: int) -> np.ndarray:
    """So many bits of each 128: words, each mixed from both halves and its own number."""
    high, low = x.view(">u8").astype(np.uint64).T
    with np.errstate(over="ignore"):
        steps = np.arange(1, bits // 64 + 1, dtype=np.uint64)
        words = _mixed(high[:, None] + np.uint64(0x9E3779B97F4A7C15) * steps) ^ _mixed(low[:, None] + np.uint64(0xD1B54A32D192ED03) * steps)
    return np.ascontiguousarray(words.astype(">u8")).view(np.uint8)


def _majority(slices_: list[np.ndarray], p: Params) -> bytes:
    ones = np.zeros(p.bits, np.int64)
    for x in slices_:
        ones += np.unpackbits(x if p.bits == 64 else _widened(x, p.bits), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > sum(map(len, slices_))).tobytes()


def fingerprint(text: bytes, p: Params) -> bytes:
    """Most significant bit first."""
    words = text.lower().split()
    return _majority(list(_digests(words, p)), p) if words else bytes(p.bits // 8)


def fingerprints(docs: DataFrame, p: Params = NEAR) -> DataFrame:
    """doc_id, fingerprint binary: a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [fingerprint(t, p) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def key_masks(nodes: int, p: Params) -> list[int]:
    """The bits of each key. With b bands, two fingerprints within the radius agree on b - radius of them at least; b is the least that gives keys of enough bits for so many nodes, or the largest with at most MOST_KEYS keys."""
    want = max(18, math.ceil(math.log2(max(2, nodes))))
    fitting = [b for b in range(p.radius + 1, p.bits + 1) if math.comb(b, p.radius) <= MOST_KEYS] or [p.radius + 1]
    b = next((b for b in fitting if p.bits * (b - p.radius) / b >= want), fitting[-1])
    edges = [round(p.bits * k / b) for k in range(b + 1)]
    bands = [((1 << hi) - (1 << lo)) for lo, hi in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(bands, b - p.radius)]


class BKTree:
    """Nodes are ints; links() joins each new node with the groups of those within the radius, skipping the members of its own group."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.up = radius, [], [], []

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.up.append(new)
        if not new:
            return
        radius, values, children = self.radius, self.values, self.children
        stack = [0]
        while stack:
            k = stack.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                a, b = self.root(k), self.root(new)
                if a != b:
                    self.up[b] = a
            for edge, child in children[k].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        at = 0
        while True:
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = new
                return
            at = children[at][d]


def shard_links(ids: list[int], values: list[int], radius: int) -> list[tuple[int, int]]:
    """(id, smallest id of its group), for the ids that have a smaller one in their group: as many links as connect each group."""
    tree = BKTree(radius)
    for v in values:
        tree.add(v)
    least: dict[int, int] = {}
    for k, x in enumerate(ids):
        r = tree.root(k)
        least[r] = min(x, least.get(r, x))
    return [(x, m) for k, x in enumerate(ids) if (m := least[tree.root(k)]) != x]


def _keyed(nodes: DataFrame, masks: list[int], p: Params) -> DataFrame:
    """shard, id, fingerprint: a row for each key of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.array([[m >> 64 * k & 2**64 - 1 for k in range(p.bits // 64)] for m in masks], np.uint64)
        for big in batches:
            for at in range(0, big.num_rows, 20_000):
                batch = big.slice(at, 20_000)
                prints = batch.column(1).to_pylist()
                value = np.frombuffer(b"".join(prints), ">u8").reshape(len(prints), -1)[:, ::-1].astype(np.uint64)
                for k, mask in enumerate(words):
                    with np.errstate(over="ignore"):
                        key = np.full(len(value), k + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        for part in (value & mask).T:
                            key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
                            key ^= key >> np.uint64(29)
                    yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], ["shard", "id", "fingerprint"])

    return nodes.select("id", "fingerprint").mapInArrow(run, "shard long, id long, fingerprint binary")


def _tree_links(keyed: DataFrame, radius: int) -> DataFrame:
    """a, b: links inside each shard. Shards arrive sorted and one after the other; those of one node need no tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            shard = table.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            out: list[tuple[int, int]] = []
            many = np.flatnonzero(np.diff(cuts) > 1)
            ids, prints = table.column("id").to_numpy(), table.column("fingerprint")
            for k in many:
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                values = [int.from_bytes(x, "big") for x in prints.slice(lo, hi - lo).to_pylist()]
                out += shard_links(ids[lo:hi].tolist(), values, radius)
            return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            shard = table.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            if cut:
                yield links(table.slice(0, cut))
            kept = table.slice(cut)
        if kept is not None and kept.num_rows:
            yield links(kept)

    return keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def _parted(keyed: DataFrame) -> DataFrame:
    """Shards of over SHARD nodes become one shard for every two of their parts."""
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD)
    parts = F.ceil(F.col("n") / SHARD).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
    split = (
        keyed.join(sizes, "shard")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .filter("own <> other")
        .select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "id", "fingerprint")
    )
    return keyed.join(sizes.select("shard"), "shard", "left_anti").unionByName(split)


def near_groups(docs: DataFrame, p: Params = NEAR) -> DataFrame:
    """doc_id, fingerprint binary, component_id: a row for each row of docs."""
    prints = materialise(fingerprints(docs, p), "simhash-prints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id")), "simhash-nodes")
    keyed = materialise(_keyed(nodes, key_masks(nodes.count(), p), p), "simhash-keyed")
    found = components(_tree_links(_parted(keyed), p.radius))
    labels = nodes.join(found, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    # a group whose smallest id is NO_ID has no id, or that very number
    real = F.when((F.col("component_id") != NO_ID) | (F.col("doc_id") == NO_ID), F.col("component_id"))
    return prints.join(labels, "fingerprint").select("doc_id", "fingerprint", real.alias("component_id"))


def _row_key() -> Column:
    """24 bytes that sort as the id, then tell the text."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).bitwiseXOR(F.lit(-(2**63)))
    return F.unhex(F.concat(F.lpad(F.hex(number), 16, "0"), F.md5(text_of())))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("row"), text_of().alias("text"))


def _sketches(docs: DataFrame, p: Params, seeds: int | None = SEEDS) -> DataFrame:
    """row, words (a digest of all words), fingerprint, size of the shingle set, prefix (its smallest hashes): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.lower().split()
                key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if not words:
                    out.append((key, bytes(p.bits // 8), 0, np.zeros(0, np.int64)))
                    continue
                made = list(_digests(words, p))
                hashes = np.unique(np.concatenate([x[:, :8] for x in made]).copy().view(np.int64))
                shared = -(-SIMILAR[0] * len(hashes) // SIMILAR[1])  # at least so many are in a near copy too
                out.append((key, _majority(made, p), len(hashes), hashes[: min(len(hashes) - shared + 1, len(hashes) if seeds is None else seeds)]))
            ends = np.cumsum([0, *(len(x[3]) for x in out)], dtype=np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[3] for x in out])))
            yield pa.record_batch(
                [batch.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64()), prefix],
                ["row", "words", "fingerprint", "size", "prefix"],
            )

    return _rows(docs).mapInArrow(run, "row binary, words binary, fingerprint binary, size long, prefix array<long>")


def _meetings(nodes: DataFrame) -> DataFrame:
    """shard, hash, node: nodes that share a hash of their prefixes. Shards of over SHARD nodes become one for every two of their parts."""
    posted = nodes.select("node", F.explode("prefix").alias("shard"))
    sizes = posted.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialise(posted.join(sizes, "shard"), "simhash-met")
    parts = F.ceil(F.col("n") / SHARD).cast("int")
    split = (
        met.filter(F.col("n") > SHARD)
        .withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .filter("own <> other")
        .select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), F.col("shard").alias("hash"), "node")
    )
    return met.filter(F.col("n") <= SHARD).select("shard", F.col("shard").alias("hash"), "node").unionByName(split)


def tree_pairs(prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(earlier place, later places within the radius) of fingerprints, rows of uint64 words.

    The BK-tree of the rows in their order: a node's children are keyed by their distance to it. The searches of all later rows reach a
    node together, and go on to the children whose key differs from their own distance by the radius at most.
    """
    everyone = np.arange(len(prints))
    stack = [(everyone, everyone[1:])]  # the rows of a subtree, its root first, and the searches that reach it
    while stack:
        rows, searches = stack.pop()
        if not len(searches):
            continue
        root = int(rows[0])
        distance = np.bitwise_count(prints[searches] ^ prints[root]).sum(1, dtype=np.int64)
        near = searches[distance <= radius]
        if len(near):
            yield root, near
        rest = rows[1:]
        if not len(rest):
            continue
        key = distance[np.searchsorted(searches, rest)]  # every row of the subtree searches it too
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
        for lo, hi in itertools.pairwise(cuts.tolist()):
            child = rest[order[lo:hi]]
            follow = searches[np.abs(distance - key[order[lo]]) <= radius]
            stack.append((child, follow[np.searchsorted(follow, child[0], "right") :]))


def shard_candidates(prints: np.ndarray, sizes: np.ndarray, groups: np.ndarray, prefixes: np.ndarray, hash_: int, radius: int, few: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places (later, earlier) of pairs within the radius, of sizes that allow SIMILAR, of distinct groups and with hash_ as the first hash that both prefixes have: a few of each later one, and whether there are more."""
    later, earlier, taken, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(sizes), np.int64), False
    for root, near in tree_pairs(prints, radius):
        least, most = np.minimum(sizes[near], sizes[root]), np.maximum(sizes[near], sizes[root])
        near = near[(SIMILAR[1] * least >= SIMILAR[0] * most) & (groups[near] != groups[root])]
        # a pair is looked at where it meets first
        lower = prefixes[root][(prefixes[root] < hash_) & (prefixes[root] != NO_HASH)]
        if len(lower) and len(near):
            near = near[~np.isin(prefixes[near], lower).any(1)]
        left = taken[near] < few
        more = more or not left.all()
        near = near[left]
        taken[near] += 1
        later.append(near)
        earlier.append(np.full(len(near), root))
    return np.concatenate(later), np.concatenate(earlier), more


def _candidates(shards: DataFrame, p: Params, few: int) -> DataFrame:
    """a, b, more: candidates of each shard; a row without a and b names a shard that has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("more", pa.int64())])

        def pairs(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            shard, node, sizes = table.column("shard").to_numpy(), table.column("node").to_pylist(), table.column("size").to_numpy()
            prints = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), np.uint64).reshape(len(shard), -1)
            hashes, lists = table.column("hash").to_numpy(), table.column("prefix").to_pylist()
            groups = np.unique(np.array(table.column("component").to_pylist(), "S24").view("V24"), return_inverse=True)[1]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            out: set[tuple] = set()
            for lo, hi in itertools.pairwise(cuts.tolist()):
                if hi - lo < 2:
                    continue
                prefixes = np.full((hi - lo, max(map(len, lists[lo:hi]))), NO_HASH, np.int64)
                for k, x in enumerate(lists[lo:hi]):
                    prefixes[k, : len(x)] = x
                a, b, more = shard_candidates(prints[lo:hi], sizes[lo:hi], groups[lo:hi], prefixes, int(hashes[lo]), p.radius, few)
                out.update((node[lo + x], node[lo + y], None) for x, y in zip(a.tolist(), b.tolist()))
                if more:
                    out.add((None, None, int(shard[lo])))
            return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            shard = table.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            if cut:
                yield pairs(table.slice(0, cut))
            kept = table.slice(cut)
        if kept is not None and kept.num_rows:
            yield pairs(kept)

    return shards.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "a binary, b binary, more long").distinct()


def shingles(text: bytes, w: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[k : k + w]) for k in range(max(1, len(words) - w + 1))} if words else set()


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows: for rows that are long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _alike(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose whole texts have a similarity of SIMILAR or more."""
    # written and counted first, so that a small list of keys goes to the texts: undecided, Spark sends all texts of docs to the keys
    needed = materialise(pairs.select("a").union(pairs.select("b")).distinct().toDF("row"), "simhash-needed")
    texts = materialise(_rows(docs).join(small(needed), "row").dropDuplicates(["row"]), "simhash-texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "text_a", "b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(iter([big])):
                keep, last, own = [], None, set()
                for x, y in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                    if x != last:
                        last, own = x, shingles(x, p.words)
                    other = shingles(y, p.words)
                    shared = len(own & other)
                    keep.append(SIMILAR[1] * shared >= SIMILAR[0] * (len(own) + len(other) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def near_links(nodes: DataFrame, docs: DataFrame, p: Params) -> DataFrame | None:
    """id, component: nodes joined by links of texts that are within the radius and alike. None where there are no candidates."""
    # who meets whom, by their ids alone: fingerprints and prefixes join them in each round, so they are never written once more
    met = _meetings(nodes)
    sketches = nodes.select("node", "fingerprint", "size", "prefix")
    tested = links = found = None
    few = FEW
    while True:
        labelled = sketches.withColumn("component", F.col("node")) if found is None else sketches.join(found.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        made = materialise(_candidates(met.join(labelled, "node").select("shard", "hash", "node", "fingerprint", "size", "prefix", "component"), p, few), "simhash-candidates")
        full, pairs = made.filter("a IS NULL").select(F.col("more").alias("shard")).distinct(), made.filter("a IS NOT NULL").select("a", "b")
        new = pairs if tested is None else materialise(pairs.join(tested, ["a", "b"], "left_anti"), "simhash-candidates")
        if not new.isEmpty():
            with _batches_of(docs.sparkSession, PAIRS):
                alike = materialise(_alike(new, docs, p), "simhash-alike")
            tested = new if tested is None else tested.unionByName(new)
            links = alike if links is None else links.unionByName(alike)
            found = materialise(components(links), "simhash-found")
        if full.isEmpty():
            return found
        met = met.join(small(full), "shard", "left_semi")
        few *= MORE


def drop_near_duplicates(docs: DataFrame, p: Params = NEAR, seeds: int | None = SEEDS) -> DataFrame:
    """The rows of docs with the smallest id of their group; all columns stay as they are. seeds: under how many hashes a text meets others, None for all that are needed to miss no pair."""
    with released(docs.sparkSession):
        rows = materialise(_sketches(docs, p, seeds), "simhash-sketches")
        first = lambda c: F.first(c).alias(c)
        nodes = materialise(rows.groupBy("words").agg(F.min("row").alias("node"), first("fingerprint"), first("size"), first("prefix")), "simhash-nodes")
        found = near_links(nodes, docs, p)
        labels = nodes.select("words", F.col("node").alias("component"))
        if found is not None:
            labels = nodes.join(found.toDF("node", "component"), "node", "left").select("words", F.coalesce("component", "node").alias("component"))
        dropped = materialise(rows.select("row", "words").join(labels, "words").filter("row <> component").select(F.col("row").alias("dropped_row")).distinct(), "simhash-dropped")
    return docs.join(small(dropped), _row_key() == dropped["dropped_row"], "left_anti")
