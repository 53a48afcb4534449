"""Vector codes, importance resampling, mixing of sources."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foretime.llm import importance, mixing, queries, vector_codes
from tests.oracle import assert_same

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, v array<long>, slot int, n long"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_importance", "op13_source_mix"])
def test_query_equals_sql(spark, small, name):
    assert_same(queries.queries()[name](spark, small), queries.oracle_sql()[name], small)


def plain_codes(rows, rounds=2, entries=64):
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // 16)
    ints = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (16 * width - len(v)), len(v)) for i, label, v in kept]
    order = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[2][: r[3]]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in order[:entries]] for p in range(16)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(16):
            held = defaultdict(list)
            for r in ints:
                held[near(p, cut(r[2], p))[1]].append(cut(r[2], p))
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, label, v, _ in ints:
        found = [near(p, cut(v, p)) for p in range(16)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    return Counter((i, code, error, sums[label]) for i, label, code, error in out), ",".join(str(x) for b in books for c in b for x in c)


def vector_rows(n, width, rnd):
    rows = [(k, [rnd.gauss(0, 0.2) for _ in range(width)], rnd.choice((1, 2, None))) for k in rnd.sample(range(10 * n), n)]
    same = [(5 * k + 10**6, rows[0][1], 1) for k in range(n // 2)]  # a third of all
    return rows + same


def as_frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1, [1], 2, 3) for i, v, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("odd", [False, True])
def test_vector_codes_equal_plain_loops(spark, odd):
    rnd = random.Random(5)
    rows = vector_rows(150, 32, rnd)
    if odd:
        nan, inf = float("nan"), float("inf")
        rows += [(7, None, 1), (8, [0.1, None] * 16, 1), (9, [nan] * 32, 1), (10, [0.0] * 31 + [-inf], 2), (11, [], 1), (12, [0.5, -0.5, 0.25], None), (None, [0.3] * 32, 2), (None, [-0.3] * 32, 2), rows[3], rows[3], (13, [1000.0, -999.9] * 16, 5)]
    want, books = plain_codes(rows)
    out, got = vector_codes.compress(as_frame(spark, rows))
    assert Counter(map(tuple, out.select("vec_id", "code", "error", "label_error").collect())) == want
    assert vector_codes.digest(got) == hashlib.sha256(books.encode()).hexdigest()


def test_vector_codes_of_few_none_and_huge(spark):
    few = [(k, [0.1 * k, 1.0, -1.0], None) for k in range(5)]
    out, books = vector_codes.compress(as_frame(spark, few))
    assert Counter(map(tuple, out.select("vec_id", "code", "error", "label_error").collect())) == plain_codes(few)[0] and books.shape == (16, 5, 1)
    for rows in ([], [(1, None, 1)]):
        out, books = vector_codes.compress(as_frame(spark, rows))
        assert out.count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    blank, _ = vector_codes.compress(as_frame(spark, [(1, [], 1), (2, [], 1)]))
    assert [tuple(r) for r in blank.select("vec_id", "code", "error").orderBy("vec_id").collect()] == [(1, "00" * 16, 0), (2, "00" * 16, 0)]
    huge, _ = vector_codes.compress(as_frame(spark, [(k, [3e38 * (-1) ** k] * 16, 1) for k in range(70)]))
    assert huge.filter("error = 0").count() == 70


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**32 - 1))
def test_distances_are_exact_and_ties_go_to_the_first(width, seed):
    rnd = np.random.default_rng(seed)
    most = vector_codes.bound(width)
    part, book = rnd.integers(-most, most, (20, width), endpoint=True), rnd.integers(-most, most, (9, width), endpoint=True)
    book[7] = book[2]
    at, d = vector_codes.nearest(part, book)
    for k in range(20):
        all_ = [sum((int(a) - int(b)) ** 2 for a, b in zip(part[k], c)) for c in book]
        assert (at[k], d[k]) == (all_.index(min(all_)), min(all_))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB 9é日\n-", max_size=300), st.sampled_from(["", " ", "x" * 5000, "y" * 47 + " " + "é" * 24 + " z", "A" * 49 + " " + "b" * 48 + " c"])), max_size=6), st.integers(0, 2))
def test_features_equal_the_crc_of_each(texts, cut):
    column = pa.array(texts, pa.string()).slice(min(cut, len(texts)))
    text, bucket, n_words = importance.features(column)
    for k, t in enumerate(texts[cut:]):
        n, want = plain_features(t)
        assert n_words[k] == n and sorted(bucket[text == k]) == sorted(want)


def plain_draw(rows, target):
    source, aim = Counter(b for _, t in rows for b in plain_features(t)[1]), Counter(b for t in target for b in plain_features(t)[1])
    S, T = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (S + 10000) / ((source[b] + 1) * (T + 10000)))) for b in source}
    out = []
    for i, t in rows:
        n, f = plain_features(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = [(i, f, w, s, k + 1) for k, (i, _, f, w, s) in enumerate(able[: 25 * len(able) // 100])]
    rest = Counter((i, f, w, s, None) for i, _, f, w, s in out)
    rest.subtract(Counter((*d[:4], None) for d in drawn))
    return +rest + Counter(drawn)


def test_importance_equals_plain_draw(spark, odd, odd_rows):
    target = [None, "", "the cat sat on the mat", *[r[1] for r in odd_rows[30:34]]]
    # a third of all rows is one row, so one score is held by many and cut
    hot = [(77, "so many words " * 8)] * 40
    rows = [(r[0], r[1]) for r in odd_rows] + hot
    docs = odd.unionByName(spark.createDataFrame(hot, "doc_id long, text string"), allowMissingColumns=True)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, got.collect())) == plain_draw(rows, target)


def test_importance_of_nothing(spark, none, odd):
    no_texts = spark.createDataFrame([], "text string")
    assert importance.resample(none, no_texts).count() == 0
    assert importance.resample(odd, no_texts).count() == odd.count()
    short = odd.filter(F.length("text") < 10)
    assert importance.resample(short, no_texts).filter("rank IS NOT NULL").count() == 0


def test_cutoffs_begin_where_higher_scores_end():
    assert importance.cutoffs({5: 2, 9: 3, 7: 4}, 6) == [(9, 0, 3), (7, 3, 3)]
    assert importance.cutoffs({5: 2}, 0) == [] and importance.cutoffs({}, 0) == []


def shares(sizes, weights=(3, 1, 2)):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if each[s] > 2 * sizes[s]}
        if not above:
            return out | each
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= above
    return out


def mixed_rows(rnd, n, sources):
    out = [(k, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice((0, 1, 5, 40, 400)))), rnd.choice(sources)) for k in range(n)]
    return out


@pytest.mark.parametrize("sources", [["a", "a", "a", "a", "b", "B", "é", None], ["only"], ["", None], [f"s{k}" for k in range(40)]])
def test_mix_takes_what_running_sums_say(spark, sources):
    rows = mixed_rows(random.Random(3), 700, sources)
    rows += [(None, "a b c", sources[0]), (None, None, sources[0]), rows[5], rows[5], (None, " \t\x0b", "blank")]
    docs = spark.createDataFrame([(i, t, s, 9, "clash") for i, t, s in rows], "doc_id long, text string, source string, size int, target string").repartition(4)
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = shares(dict(sizes))
    key = lambda i, t: int(hashlib.sha256(str(i if i is not None else "text:" + (t or "")).encode()).hexdigest()[:15], 16)
    expected = Counter()
    for s in sizes:
        own = [(key(i, t), i, count(t)) for i, t, x in rows if x == s]
        times = int(want[s] // sizes[s]) if sizes[s] else 0
        budget, run, taken = want[s] - times * sizes[s], 0, set()
        for h in sorted({h for h, _, _ in own}):
            words = sum(n for k, _, n in own if k == h)
            if run + words <= budget or (run <= budget and budget - run >= run + words - budget):
                taken.add(h)
            run += words
        for h, i, n in own:
            expected[(i, n, sizes[s], round(want[s], 6), n * (times + (h in taken)))] += 1
        assert abs(sum(n * (times + (h in taken)) for h, _, n in own) - want[s]) <= max(sum(n for k, _, n in own if k == h) for h, _, _ in own) / 2 + 1e-6
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == expected
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_mix_of_nothing_and_of_larger_targets(spark, none):
    assert mixing.mix(none).count() == 0
    rows = mixed_rows(random.Random(8), 400, ["a", "b", "c"])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    less, more = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, share=s).collect()} for s in (0.4, 0.9))
    assert all(less[i] <= more[i] for i in less)
    assert {r["taken"] == 2 * r["size"] for r in mixing.mix(docs, share=2.0).collect()} == {True}


def test_few_needed_texts_are_found_without_sending_all(spark, monkeypatch):
    from foretime.llm import simhash as near

    plans, real = {}, near.materialise
    monkeypatch.setattr(near, "materialise", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1])
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    rows = [r["row"] for r in near._rows(docs).collect()]
    pairs = spark.createDataFrame([(rows[0], rows[1]), (rows[0], rows[2])], "a binary, b binary")
    assert [tuple(r) for r in near._alike(pairs, docs, near.NEAR).collect()] == [(rows[0], rows[1])]
    assert "strategy=broadcast" in plans["simhash-texts"]
