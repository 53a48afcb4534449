"""Best-fit packing of token sequences by bin completion.

Documents are tokenised, closed by an end id and cut into pieces of at most
CAPACITY tokens. How many pieces have each length is a table of at most CAPACITY
rows whatever the corpus, and packing needs no more: the plan is made over that
table by branch and bound and says for each length which sequence slots its pieces
take; the pieces find their slots by their rank among those of their length, which
Spark computes from counts by (length, bucket).

Bin completion: the largest remaining piece gets a sequence, the fillings around it
that no other dominates are tried in order of waste, and a branch ends when its waste
exceeds what a better plan than the incumbent may waste. A filling is repeated as
often as the counts allow. The first incumbent is best-fit decreasing. The search ends
at the lower bound or after NODES fillings; the plan is then the best found, always a
whole one.

Cases: a null or empty text is one piece of one token (the end id). A null id is
carried as null. Rows that repeat are packed each. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, slices, text_of

CAPACITY = 2048
END_ID = 0
#: Entries of a task's table of distinct words.
TABLE_WORDS = 300_000
#: Fillings that the search looks at before it settles for its incumbent.
NODES = 6_000
#: Steps of the search that keep their generator of fillings, each up to a megabyte; those above make theirs anew when the search comes back.
KEPT_STEPS = 16


class WordIds:
    """Ids of texts by a table of distinct words: white space ends every token of this vocabulary, so the words between blanks are encoded one by one.

    The vocabulary is of small letters; A-Z are lower-cased first, so that a word and its capitalised form are one entry.
    A word of Latin letters alone is one token run whose last id, and no other, ends a word; such words are encoded many
    at once, cut at blanks alone, and their ids cut at those ids. A word of letters and one comma or full stop is those two runs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.ids = Tokenizer.from_file(path), {}
        # for Latin letters the normaliser is lower case, and the pattern that cuts texts cuts at blanks
        self.latin = Tokenizer(self.tokenizer.model)
        self.latin.normalizer = normalizers.Lowercase()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for word, k in vocab.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.ids = {"": b""} | {x: self.one(x) for x in ",."}

    def one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        letters, ended, others = set(), [], []
        for x in words:
            if x.isalpha() and (x.isascii() or max(x) < "\u0250"):
                letters.add(x)
            elif x[-1] in ",." and x[:-1].isalpha() and (x.isascii() or max(x) < "\u0250"):
                letters.add(x[:-1])
                ended.append(x)
            else:
                others.append(x)
        some = [x for x in letters if x not in self.ids]
        for at in range(0, len(some), 5_000):
            part = some[at : at + 5_000]
            ids = np.array(self.latin.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                self.ids.update((x, self.one(x)) for x in part)
                continue
            raw, ends = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.ids.update(zip(part, [raw[a:b] for a, b in zip(ends, ends[1:])]))
        self.ids.update([(x, self.ids[x[:-1]] + self.ids[x[-1]]) for x in ended])
        for at in range(0, len(others), 5_000):
            part = others[at : at + 5_000]
            self.ids.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without the end id."""
        # bytes.lower changes A-Z alone
        cut = [t.encode().lower().replace(b"\n", b" ").decode().split(" ") for t in texts]
        if len(self.ids) > TABLE_WORDS:
            self.clear()
        self.learn(set().union(*cut).difference(self.ids))
        return [b"".join(map(self.ids.__getitem__, x)) for x in cut]


@cache
def _words(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit): the pieces of each row of docs."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = zip(*rows)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


Filling = tuple[tuple[int, int], ...]  # (length, times in the sequence)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Pieces by falling length, each into the fullest open sequence that takes it; equal sequences are handled together."""
    open_: dict[int, dict[Filling, int]] = {capacity: {(): sum(counts.values())}}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min(r for r, x in open_.items() if r >= length and x)
            filling, n = next(iter(open_[room].items()))
            k = min(n, left)
            held = dict(filling)
            held[length] = held.get(length, 0) + 1
            after = tuple(sorted(held.items(), reverse=True))
            if k == n:
                del open_[room][filling]
            else:
                open_[room][filling] = n - k
            into = open_.setdefault(room - length, {})
            into[after] = into.get(after, 0) + k
            left -= k
    return [(f, n) for x in open_.values() for f, n in x.items() if f]


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """The undominated fillings of room, least waste first, found one by one; None stands for a dominated one that was passed over.

    Totals below the largest single piece are dominated by it. Which totals can be made of the pieces from a length down
    is known beforehand, so no step leads into a dead end.
    """
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if not lengths:
        yield ()
        return
    reach = [1] * (len(lengths) + 1)  # bit t: pieces of lengths[k:] make a total of t
    for k in range(len(lengths) - 1, -1, -1):
        bits, left, part = reach[k + 1], min(int(counts[lengths[k]]), room // lengths[k]), 1
        while left > 0:
            bits |= bits << lengths[k] * min(part, left)
            left, part = left - part, part * 2
        reach[k] = bits & (1 << room + 1) - 1

    def made(k: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
        for j in range(k, len(lengths)):
            if not total or not reach[j] >> total & 1:
                return
            for times in range(min(int(counts[lengths[j]]), total // lengths[j]), 0, -1):
                if reach[j + 1] >> total - times * lengths[j] & 1:
                    for rest in made(j + 1, total - times * lengths[j]):
                        yield (lengths[j],) * times + rest

    for total in range(room, lengths[0] - 1, -1):
        if reach[0] >> total & 1:
            for filling in made(0, total):
                yield None if _dominated(filling, counts, room) else filling


def _dominated(filling: tuple[int, ...], counts: np.ndarray, room: int) -> bool:
    """Whether one piece at hand could take the place of two or more of the filling's, or of a smaller one, within the room."""
    waste = room - sum(filling)
    sums, pairs = {0}, set()  # totals of some pieces, and of two or more
    for x in filling:
        pairs |= {p + x for p in pairs} | {s + x for s in sums if s}
        sums |= {s + x for s in sums}
    held = {x: filling.count(x) for x in filling}
    at_hand = lambda y: counts[y] > held.get(y, 0)
    return any(at_hand(y) for s in pairs for y in range(s, s + waste + 1)) or any(at_hand(y) for x in held for y in range(x + 1, x + waste + 1))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: by total length, and with pieces over half of the capacity apart from all others too long for their rest."""
    most = -(-sum(k * n for k, n in counts.items()) // capacity)
    for cut in range(0, capacity // 2 + 1, 16):
        large = sum(n for k, n in counts.items() if k > capacity - cut)
        middle = {k: n for k, n in counts.items() if capacity // 2 < k <= capacity - cut}
        small = sum(k * n for k, n in counts.items() if cut <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in middle.items())
        most = max(most, large + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return most


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: float = NODES, repeat: bool = True) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences each gets, for so many pieces of each length. With repeat a filling is taken as often as counts allow; without it, and with infinite nodes, the plan is optimal."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    fewest, least = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    path: list[tuple[Filling, int]] = []
    waste, bins = 0, 0
    stack: list[list] = []  # of steps: largest, the fillings still to try or None, how many were tried

    def options_of(largest: int) -> Iterator[tuple[int, ...] | None]:
        left[largest] -= 1
        options = fillings(left.copy(), capacity - largest)
        left[largest] += 1
        return options

    def step() -> None:
        largest = int(np.flatnonzero(left)[-1])
        stack.append([largest, options_of(largest), 0])
        if len(stack) > KEPT_STEPS:
            stack[-KEPT_STEPS - 1][1] = None

    if counts and fewest > least:
        step()
    while stack and nodes > 0:
        largest, options, tried = stack[-1]
        if len(path) == len(stack):  # take back what was tried last here
            filling, n = path.pop()
            for k, m in filling:
                left[k] += m * n
            bins -= n
            waste -= n * (capacity - sum(k * m for k, m in filling))
        if options is None:  # what is left is what it was when the step began
            options = stack[-1][1] = itertools.islice(options_of(largest), tried, None)
        option = next(options, "none")
        if option == "none":
            stack.pop()
            continue
        stack[-1][2] += 1
        nodes -= 1
        if option is None:
            continue
        held: dict[int, int] = {largest: 1}
        for k in option:
            held[k] = held.get(k, 0) + 1
        n = int(min(left[k] // m for k, m in held.items())) if repeat else 1
        lost = capacity - largest - sum(option)
        path.append((tuple(sorted(held.items(), reverse=True)), n))
        for k, m in held.items():
            left[k] -= m * n
        bins += n
        waste += n * lost
        if waste > (fewest - 1) * capacity - total:
            continue  # no better plan below
        if left.any():
            step()
            continue
        if bins < fewest:
            best, fewest = list(path), bins
            if fewest <= least:
                break
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, and columns to carry) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = materialise(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *carry), "pack-pieces")
    buckets = max(16, pieces.count() // 500_000)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence, used = [], 0, dict.fromkeys(by_length, 0)
    for filling, n in plan(by_length, capacity):
        offset = 0
        for length, times in filling:
            slots.append((length, used[length], used[length] + times * n, sequence, times, offset))
            used[length] += times * n
            offset += length * times
        sequence += n
    # a few slots for each length and filling, and fewer fillings than twice the lengths: its size depends on capacity alone.
    # The counts by length and bucket, which grow with the pieces, are joined without a hint
    table = F.broadcast(spark.createDataFrame(slots, "slot_length long, lo long, hi long, first long, times long, at long").coalesce(1))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = pieces.join(counts.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)
    in_slot = F.col("rank") - F.col("lo")
    return ranked.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        *carry,
        (F.col("first") + F.floor(in_slot / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(in_slot, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs; with ids also the token ids of each piece, little-endian unsigned 32-bit, so that a sequence is its pieces' ids by offset."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity, ("ids",) if ids else ())
