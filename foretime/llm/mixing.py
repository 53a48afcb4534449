"""A mix of sources by target weights, drawn by nested thresholds of a hash.

The sources, in order of their names, weigh WEIGHTS in turn. Together they get SHARE of all words; a source gets no
more than REPEATS times its own words, and what it would get beyond is shared among the others by weight, until none is
above. A document has a fixed 60-bit hash. A source takes all its documents as many whole times as its target
allows, and once more those whose hash is at most a threshold, so a smaller target takes a part of what a larger one
takes.

The threshold is found without sorting documents: words are added up by source and the highest LEVEL bits of the hash;
the bucket in which the sum passes what is left of the target is split by the next bits, and so on; only the
documents of that bucket are read further. The last step goes by whole hashes. The document at the threshold is taken when
that brings the sum nearer to the target, so a source misses its target by half of one document at most (rows that
share an id count as one document here).

Everything is an aggregation; each source has 2 ** LEVEL rows at most in a step. Tables of one row for each source are
broadcast when they are counted to be few.

Cases: a null text has size 0; a null source is one source, after all others, and an empty name another. The hash is of the id,
of the text for rows without one; rows that share a hash are taken or left together. An empty table gives an empty
result. Sources without words have the target 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.operators.ranking import whole_row_number

from ._common import materialise, small, text_of

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Bits of the hash, and those that a step adds.
BITS, LEVEL = 60, 12


def word_count(text: Column) -> Column:
    """Number of runs of signs that aren't white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h: what the steps read of each document, written as a table."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text_of()))
    h = F.conv(F.substring(F.sha2(key, 256), 1, BITS // 4), 16, 10).cast("long")
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), h.alias("h")), "mix-sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: a row for each source.

    Every round of the sharing is one aggregation over the sources: those above their limit are held at it, and the rest of
    the words is dealt by weight to the others. The held ones only grow, so it ends when their number stays.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = whole_row_number(by.withColumn("no_name", F.col("source").isNull()), ["no_name", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    by = materialise(ordered.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * repeats).cast("double").alias("most")), "mix-sources")
    first = by.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight_sum, held = share * (first["words"] or 0), first["weight"] or 1.0, 0
    left, free = words, weight_sum
    above = lambda: F.col("most") * F.lit(free) < F.lit(left) * F.col("weight")
    while True:
        r = by.agg(F.sum(F.when(above(), F.col("most"))).alias("most"), F.sum(F.when(above(), F.col("weight"))).alias("weight"), F.count(F.when(above(), 1)).alias("n")).first()
        if r["n"] == held:
            break
        held, left, free = r["n"], words - r["most"], weight_sum - r["weight"]
    return by.select("source", "source_size", F.when(above(), F.col("most")).otherwise(F.lit(left) * F.col("weight") / F.lit(max(free, 1.0))).alias("target"))


def _passed(sums: DataFrame, by: str) -> DataFrame:
    """The row of each source at which the running sum of `words`, plus what lies below, passes `budget`; before is the sum ahead of it."""
    running = Window.partitionBy("source").orderBy(by)
    out = sums.withColumn("after", F.col("below") + F.sum("words").over(running)).withColumn("before", F.col("after") - F.col("words"))
    return out.filter((F.col("before") <= F.col("budget")) & (F.col("after") > F.col("budget")))


def _met(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source's row."""
    sources = sources.withColumnRenamed("source", "its_source")
    return rows.join(small(sources), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: of the sources (source, budget) whose budget ends within their documents, the largest hash that is taken."""
    at, inside = materialise(budgets.select("source", "budget", F.lit(0).cast("long").alias("below")), "mix-bucket"), rows
    for bits in range(LEVEL, 3 * LEVEL + 1, LEVEL):
        next_bits = F.shiftright("h", BITS - bits)
        sums = _met(inside, at).groupBy("source", "budget", "below", next_bits.alias("prefix")).agg(F.sum("size").alias("words"))
        at = materialise(_passed(sums, "prefix").select("source", "budget", F.col("before").alias("below"), "prefix"), "mix-bucket")
        inside = materialise(_met(inside, at).filter(next_bits == F.col("prefix")).select("source", "size", "h"), "mix-inside")
    inside = _met(inside, at)
    sums = inside.groupBy("source", "budget", "below", "h").agg(F.sum("size").alias("words"))
    last = _passed(sums, "h")
    return last.select("source", F.when(F.col("budget") - F.col("before") >= F.col("after") - F.col("budget"), F.col("h")).otherwise(F.col("h") - 1).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, whole documents repeated."""
    rows = sized(docs)
    goals = targets(rows, weights, share, repeats)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    goals = materialise(goals, "mix-targets")
    ends = thresholds(rows, goals.filter("budget > 0")).withColumnRenamed("source", "end_source")
    goals = materialise(goals.join(ends, goals["source"].eqNullSafe(ends["end_source"]), "left").select("source", "source_size", "target", "times", F.coalesce("threshold", F.lit(-1)).alias("threshold")), "mix-thresholds")
    taken = F.col("size") * (F.col("times") + (F.col("h") <= F.col("threshold")).cast("long"))
    return _met(rows, goals).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
