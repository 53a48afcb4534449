"""Point-in-time operators: what a row may know comes strictly before it.

ROWS frames (prior_rows) look at the rows before in a total order, so an earlier row of
the same day counts. RANGE frames by day (trailing_days, expanding_before, decayed_before)
leave out the whole own day and run over sums by day, however many rows a day has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.functions.calendar import day_number
from foretime.functions.guards import ratio


def prior_rows(df: DataFrame, keys: list[str], order: list[str], values: list[str], n: int, how: str = "sum", least: int = 1) -> DataFrame:
    """{value}_{how}_{n}: an aggregate of the n rows before; NULL when fewer than least of them are known."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    agg = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}[how]
    return df.withColumns({f"{v}_{how}_{n}": F.when(F.count(v).over(w) >= least, agg(v).over(w)) for v in values})


def prior_ratios(df: DataFrame, keys: list[str], order: list[str], ratios: dict[str, tuple[str, str, float]], windows: list[int]) -> DataFrame:
    """{name}_{w} for each window: scale * sum(num) / sum(den) over the w rows before, and rows_{w}, how many there were.

    Ratios of sums, not means of ratios. All windows share one sort.
    """
    base = Window.partitionBy(*keys).orderBy(*order)
    out = {}
    for n in windows:
        w = base.rowsBetween(-n, -1)
        out[f"rows_{n}"] = F.count(F.lit(1)).over(w).cast("int")
        for name, (num, den, scale) in ratios.items():
            out[f"{name}_{n}"] = ratio(F.sum(num).over(w), F.sum(den).over(w), scale)
    return df.withColumns(out)


def cumulative_before(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """{value}_before: the sum over all rows before, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})


def trailing_days(df: DataFrame, keys: list[str], date: str, values: list[str], days: int) -> DataFrame:
    """{value}_{days}d: the sum over the days before, own day left out; 0 if there are none. The window runs over sums by day."""
    out = day_sums(df, keys, date, values, {"d": (-days, -1)})
    return out.withColumns({f"{v}_{days}d": F.coalesce(f"{v}_sum_d", F.lit(0)) for v in values}).drop("rows_d", *[f"{v}_{k}_d" for v in values for k in ("sum", "n")])


def day_sums(df: DataFrame, keys: list[str], date: str, values: list[str], frames: dict[str, tuple[int | None, int]]) -> DataFrame:
    """df with {value}_sum_{frame}, {value}_n_{frame} and rows_{frame} over days (lo, hi) from the own one; lo may be None, for all days before.

    Rows are added up by key and day first, so the window sorts a row for each day, however many rows a key has; the sums are
    joined back, and Spark may split that join where a key is hot.
    """
    day = day_number(F.col(date))
    by = df.groupBy(*keys, F.col(date).alias("__day")).agg(F.count(F.lit(1)).alias("__rows"), *[f(v).alias(f"__{name}_{v}") for v in values for name, f in (("s", F.sum), ("n", F.count))])
    out = {}
    for frame, (lo, hi) in frames.items():
        w = Window.partitionBy(*keys).orderBy(day_number(F.col("__day"))).rangeBetween(Window.unboundedPreceding if lo is None else lo, hi)
        out[f"rows_{frame}"] = F.coalesce(F.sum("__rows").over(w), F.lit(0))
        for v in values:
            out[f"{v}_sum_{frame}"], out[f"{v}_n_{frame}"] = F.sum(f"__s_{v}").over(w), F.coalesce(F.sum(f"__n_{v}").over(w), F.lit(0))
    by = by.withColumns(out).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], day_number(F.col("__day")).alias("__at"), *out)
    same = day.eqNullSafe(by["__at"])
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(by[f"__key{i}"])
    return df.join(by, same, "left").drop("__at", *[f"__key{i}" for i in range(len(keys))])


def expanding_before(df: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """{value}_sum_before and n_before over all strictly earlier days."""
    out = day_sums(df, keys, date, values, {"before": (None, -1)})
    return out.withColumns({f"{v}_sum_before": F.coalesce(f"{v}_sum_before", F.lit(0.0)) for v in values}).withColumnRenamed("rows_before", "n_before").drop(*[f"{v}_n_before" for v in values])


def decayed_before(df: DataFrame, keys: list[str], date: str, values: list[str], half_life: float) -> DataFrame:
    """{value}_decayed: the sum over strictly earlier days of value * 0.5^(age / half_life).

    Rows are added up by key and day first. The growing weight 2^(day / half_life) is summed over the days and scaled back, so one
    running sum does it. Days count from the first of the key; a key that spans over 900 half-lives, where the weight would
    leave the range of doubles, is an error.
    """
    by = df.groupBy(*keys, F.col(date).alias("__day")).agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    days = day_number(F.col("__day"))
    age = (days - F.min(days).over(Window.partitionBy(*keys))) / F.lit(float(half_life))
    age = F.when(age <= 900, age).when(age > 900, F.raise_error(F.lit("a key spans over 900 half-lives")).cast("double"))
    w = Window.partitionBy(*keys).orderBy(days).rangeBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("__age", age)
    sums = {f"{v}_decayed": F.coalesce(F.sum(F.col(f"__s_{v}") * F.pow(F.lit(2.0), F.col("__age"))).over(w), F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("__age")) for v in values}
    by = by.withColumns(sums).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__day"), *sums)
    same = df[date].eqNullSafe(by["__day"])
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(by[f"__key{i}"])
    return df.join(by, same, "left").drop("__day", *[f"__key{i}" for i in range(len(keys))])


def breaks(df: DataFrame, keys: list[str], seconds: str, gap: int) -> DataFrame:
    """keys, before, after: neighbouring instants (whole seconds) of a key that are over gap apart.

    Within a bucket of that length no two are, so instants are added up to the first and last of each bucket, and the window
    runs over buckets.
    """
    by = df.groupBy(*keys, F.floor(F.col(seconds) / gap).alias("__bucket")).agg(F.min(seconds).alias("after"), F.max(seconds).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))
    return by.withColumn("before", before).filter(F.col("after") - F.col("before") > gap).select(*keys, "before", "after")


def shrunk(value: Column, n: Column, k: float, prior: Column) -> Column:
    """z * value + (1 - z) * prior with credibility z = n / (n + k); the prior where nothing is known."""
    z = n / (n + F.lit(float(k)))
    return F.when((n > 0) & value.isNotNull(), z * value + (1 - z) * prior).otherwise(prior)


def season_to_date_rate(df: DataFrame, keys: list[str], season: str, date: str, num: str, den: str, prior: str, weight: float) -> DataFrame:
    """df with env: (sum(num) + weight * prior) / (sum(den) + weight) over strictly earlier days of the season."""
    out = day_sums(df, [*keys, season], date, [num, den], {"env": (None, -1)})
    s, t = (F.coalesce(f"{c}_sum_env", F.lit(0.0)) for c in (num, den))
    return out.withColumn("env", (s + F.lit(weight) * F.col(prior)) / (t + F.lit(weight))).drop("rows_env", *[f"{c}_{x}_env" for c in (num, den) for x in ("sum", "n")])


def fast_and_slow(df: DataFrame, keys: list[str], date: str, value: str, fast: tuple[int, float], slow: tuple[int, float], prior: float) -> DataFrame:
    """{value}_env: the rate of the last fast days shrunk to that of the last slow days, that one shrunk to prior. fast and slow are (days, weight in rows)."""
    out = day_sums(df, keys, date, [value], {"fast": (-fast[0], -1), "slow": (-slow[0], -1)})

    def rate(frame: str, weight: float, to: Column) -> Column:
        return (F.coalesce(f"{value}_sum_{frame}", F.lit(0.0)) + weight * to) / (F.col(f"{value}_n_{frame}") + weight)

    out = out.withColumn(f"{value}_env", rate("fast", fast[1], rate("slow", slow[1], F.lit(prior))))
    return out.drop(*[c for x in ("fast", "slow") for c in (f"rows_{x}", f"{value}_sum_{x}", f"{value}_n_{x}")])


def previous_event(df: DataFrame, keys: list[str], order: list[str], ts: str, carry: list[str], cap: float = 600.0) -> DataFrame:
    """seconds_since (capped) and prev_{c}: what the event before in the group was; NULL for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return df.withColumns({"seconds_since": F.when(gap > cap, F.lit(cap)).otherwise(gap)} | {f"prev_{c}": F.lag(c).over(w) for c in carry})


def recent_count(df: DataFrame, keys: list[str], order: list[str], ts: str, seconds: int) -> DataFrame:
    """recent: how many earlier rows of the group lie within so many seconds before; earlier rows of the same second count.

    Rows are dealt into buckets of that length; what a row counts lies in its own and the one before, so each row goes to
    its own bucket and the next, and a hot group is spread over its buckets.
    """
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    own = F.floor(at / seconds)
    both = df.withColumn("__b", F.explode(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")), F.struct((own + 1).alias("bucket"), F.lit(False).alias("own")))))
    rows = Window.partitionBy(*keys, "__b.bucket").orderBy(at, *order)
    old = Window.partitionBy(*keys, "__b.bucket").orderBy(at).rangeBetween(Window.unboundedPreceding, -(seconds + 1))
    return both.withColumn("recent", (F.row_number().over(rows) - 1 - F.count(F.lit(1)).over(old)).cast("long")).filter("__b.own").drop("__b")


def top_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. order must be total; Spark prunes to one row for each key and task before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, lead: int, tie: list[str] = [], strict: bool = True) -> DataFrame:  # noqa: B006
    """left with one column `match`: a struct of the last right row of its keys with ts before (or, not strict, at) left's and at most lead seconds older; else NULL.

    Both sides meet in buckets of lead seconds: a right row goes to its bucket and the next one, so a left row
    finds all it may see in one bucket, and a key with very many rows is spread over its buckets. In a bucket one sorted
    pass carries the last right row along, so no pairs are made. tie orders right rows of one instant: the last counts.
    """
    width = lead * 1_000_000
    bucket = lambda ts: F.floor(_seconds(ts) / width).cast("long")
    lcols, rcols = left.columns, right.columns
    both = F.array(bucket(right_ts), bucket(right_ts) + 1)
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.explode(both).alias("__bucket"),
        _seconds(right_ts).alias("__ts"),
        F.lit(0 if strict is False else 1).alias("__side"),
        F.struct(*[F.col(t) for t in tie]).alias("__tie") if tie else F.struct(F.lit(0).alias("none")).alias("__tie"),
        F.struct(*rcols).alias("__right"),
        F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType).alias("__left"),
    )
    known = F.col(left_ts).isNotNull()
    l = left.select(  # noqa: E741
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.when(known, bucket(left_ts)).alias("__bucket"),
        _seconds(left_ts).alias("__ts"),
        F.lit(1 if strict is False else 0).alias("__side"),
        F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"),
        F.lit(None).cast(r.schema["__right"].dataType).alias("__right"),
        F.struct(*lcols).alias("__left"),
    )
    parts = [f"__k{i}" for i in range(len(keys))]
    w = Window.partitionBy(*parts, "__bucket").orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("__right").isNotNull(), F.struct("__ts", "__right")), ignorenulls=True).over(w)
    out = l.unionByName(r).withColumn("__seen", seen).filter(F.col("__left").isNotNull())
    fresh = (F.col("__ts") - F.col("__seen.__ts") <= width) & F.col("__ts").isNotNull()
    return out.select("__left.*", F.when(fresh, F.col("__seen.__right")).alias("match"))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, window: int, tie: str) -> DataFrame:
    """left with `match`: a struct of the right row of its keys nearest in time, at most window seconds away; of two as near the earlier, of one instant the lowest tie.

    Buckets of window seconds hold right rows three times; two sorted passes carry the rows before and after along.
    """
    width = window * 1_000_000
    bucket = lambda ts: F.floor(_seconds(ts) / width).cast("long")
    lcols, rcols = left.columns, right.columns
    parts = [f"__k{i}" for i in range(len(keys))]
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *[F.col(k).alias(p) for k, p in zip(keys, parts)],
        F.explode(F.sequence(bucket(right_ts) - 1, bucket(right_ts) + 1)).alias("__bucket"),
        _seconds(right_ts).alias("__ts"),
        F.col(tie).alias("__tie"),
        F.struct(*rcols).alias("__right"),
        F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType).alias("__left"),
    )
    l = left.select(  # noqa: E741
        *[F.col(k).alias(p) for k, p in zip(keys, parts)],
        bucket(left_ts).alias("__bucket"),
        _seconds(left_ts).alias("__ts"),
        F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"),
        F.lit(None).cast(r.schema["__right"].dataType).alias("__right"),
        F.struct(*lcols).alias("__left"),
    )
    both = l.unionByName(r)
    one = F.when(F.col("__right").isNotNull(), F.struct("__ts", "__right"))
    group = Window.partitionBy(*parts, "__bucket")
    # before: among rows of one instant the lowest tie comes last; after: it comes first
    back = F.last(one, ignorenulls=True).over(group.orderBy(F.col("__ts"), F.col("__tie").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.last(one, ignorenulls=True).over(group.orderBy(F.col("__ts").desc(), F.col("__tie").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumns({"__back": back, "__ahead": ahead}).filter(F.col("__left").isNotNull())
    db, da = F.col("__ts") - F.col("__back.__ts"), F.col("__ahead.__ts") - F.col("__ts")
    pick = F.when((db <= width) & (da.isNull() | (da > width) | (db <= da)), F.col("__back.__right")).when(da <= width, F.col("__ahead.__right"))
    return out.select("__left.*", pick.alias("match"))


def poison_future(df: DataFrame, date: str, cutoff: str, values: list[str], with_: float = 1e9) -> DataFrame:
    """df with the values of all rows from cutoff on overwritten: no result before cutoff may change by it."""
    late = F.col(date) >= F.lit(cutoff).cast(df.schema[date].dataType)
    return reduce(lambda d, v: d.withColumn(v, F.when(late, F.lit(with_).cast(df.schema[v].dataType)).otherwise(F.col(v))), values, df)
