"""Scores, calibration and tests as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.sources.shared import written

EPS = 1e-15


def log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(y: Column, p: Column) -> Column:
    return F.pow(p - y, 2)


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate for bins of equal width."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """ece: the mean gap of the bins, weighted by their rows."""
    return reliability(df, y, p, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def scores(df: DataFrame, y: str, p: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, log_loss, brier, accuracy, for each group and, with groups, pooled (group NULL): one ROLLUP."""
    yy, pp = F.col(y).cast("double"), F.col(p)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(log_loss(yy, pp)).alias("log_loss"), F.avg(brier(yy, pp)).alias("brier"), F.avg(((pp >= 0.5) == (yy == 1)).cast("double")).alias("accuracy")]
    return (df.rollup(*by) if by else df).agg(*aggs)


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve by the rank sum with mean ranks of ties, exact.

    Rows are counted by score first; scores are dealt by ranges, written once, and each range adds the counts of those below, which are
    one row for each partition. Rows without a score or a label are left out.
    """
    label = F.col(y).cast("long")
    by = df.filter(label.isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("s")).agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(by.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()), "auc-scores")
    # a row for each partition
    ahead = dealt.groupBy("part").agg(F.sum("neg").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = dealt.withColumn("own", own).join(F.broadcast(ahead), "part").select((F.col("pos") * (F.col("ahead") + F.col("own") + F.col("neg") / 2)).alias("u"), "pos", "neg")
    return each.agg(F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, diff, se, z of the mean of a - b."""
    d = F.col(a) - F.col(b)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("diff"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se")).withColumn("z", F.when(F.col("se") > 0, F.col("diff") / F.col("se")))


def clustered(df: DataFrame, d: str, cluster: str) -> DataFrame:
    """n, clusters, mean and its standard error when rows of a cluster hang together: sqrt(G / (G - 1) * sum(S_g^2)) / n."""
    by = df.groupBy(cluster).agg(F.sum(d).alias("s"), F.count(d).alias("k"))
    total = by.agg(F.sum("s").alias("s"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("k")).alias("sk"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    m = F.col("s") / F.col("n")
    spread = F.col("ss") - 2 * m * F.col("sk") + m * m * F.col("kk")
    se = F.sqrt(F.col("g") / (F.col("g") - 1) * spread) / F.col("n")
    return total.select("n", F.col("g").alias("clusters"), m.alias("mean"), se.alias("se"))


def slope(df: DataFrame, y: str, x: str) -> DataFrame:
    """n, slope, intercept, se, t of a simple regression."""
    n, b, sxx, syy, sxy = F.count(F.lit(1)), F.regr_slope(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    out = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(n.alias("n"), b.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx).alias("se"))
    return out.withColumn("t", F.col("slope") / F.col("se"))


def edge_bucket(edge: Column, cuts: list[float]) -> Column:
    """Half-open buckets by name: <a, [a,b), ..., >=z."""
    out = F.when(edge < cuts[0], f"<{cuts[0]:g}")
    for lo, hi in zip(cuts, cuts[1:]):
        out = out.when((edge >= lo) & (edge < hi), f"[{lo:g},{hi:g})")
    return out.when(edge >= cuts[-1], f">={cuts[-1]:g}")


def between_within_k(df: DataFrame, key: str, value: str, least: int = 5, fallback: float = 66.0) -> DataFrame:
    """k: the credibility constant MSW / ((MSB - MSW) / m0) of a one-way random-effects model over keys with at least so many rows."""
    by = df.groupBy(key).agg(F.count(value).alias("m"), F.avg(value).alias("mean"), F.var_samp(value).alias("v")).filter(F.col("m") >= least)
    t = by.agg(
        F.count(F.lit(1)).alias("i"),
        F.sum("m").alias("n"),
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("m") * F.col("mean")).alias("s"),
        F.sum(F.col("m") * F.col("mean") * F.col("mean")).alias("q"),
        F.sum((F.col("m") - 1) * F.col("v")).alias("w"),
    )
    msw = F.col("w") / (F.col("n") - F.col("i"))
    msb = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("i") - 1)
    m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("i") - 1)
    k = msw / ((msb - msw) / m0)
    return t.select(F.when((msb > msw) & (k > 0), k).otherwise(F.lit(fallback)).alias("k"))


def bootstrap_ratio(df: DataFrame, num: str, den: str, cluster: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """ratio, lo, hi: a 95 % interval of sum(num) / sum(den) by resampling clusters.

    Clusters are summed first. Each gets in each resample a Poisson(1) weight from a hash of (cluster, resample, seed), so
    nothing is collected, resamples are repeatable and the shuffle carries one row for each task and resample.
    """
    sums = df.groupBy(cluster).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    u = (F.pmod(F.xxhash64(F.col(cluster), F.col("r"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    weight, mass, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(10):
        total += mass
        weight = weight + (u > total).cast("int")
        mass /= k + 1
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    each = drawn.groupBy("r").agg((F.sum(F.col("a") * F.col("w")) / F.sum(F.col("b") * F.col("w"))).alias("ratio"))
    ends = each.agg(F.percentile("ratio", F.lit(0.025)).alias("lo"), F.percentile("ratio", F.lit(0.975)).alias("hi"))
    whole = sums.agg((F.sum("a") / F.sum("b")).alias("ratio"), F.lit(1).alias("one"))
    return whole.join(ends.withColumn("one", F.lit(1)), "one").drop("one")


def clustered_regression(df: DataFrame, y: str, x: str, cluster: list[str]) -> DataFrame:
    """intercept, slope, se_intercept, se_slope of y on x, errors clustered with the factor G / (G - 1). Two aggregations: moments, then scores by cluster."""
    m = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"))
    m = m.select("n", "mx", "my", "vx", (F.col("cxy") / F.col("vx")).alias("slope")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    e = F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    # one row of moments meets all rows
    scores = df.crossJoin(F.broadcast(m)).groupBy(*cluster).agg(F.sum(e).alias("s0"), F.sum(e * (F.col(x) - F.col("mx"))).alias("s1"))
    meat = scores.agg(F.count(F.lit(1)).alias("g"), F.sum(F.col("s0") ** 2).alias("m00"), F.sum(F.col("s0") * F.col("s1")).alias("m01"), F.sum(F.col("s1") ** 2).alias("m11"))
    # with x centred the design is orthogonal: the slope's variance is m11 / (n vx)^2
    sxx, k, factor = F.col("n") * F.col("vx"), F.col("mx"), F.col("g") / (F.col("g") - 1)
    v1 = factor * F.col("m11") / sxx**2
    v0 = factor * (F.col("m00") / F.col("n") ** 2 - 2 * k * F.col("m01") / (F.col("n") * sxx) + k**2 * F.col("m11") / sxx**2)
    return m.crossJoin(F.broadcast(meat)).select("intercept", "slope", F.sqrt(v0).alias("se_intercept"), F.sqrt(v1).alias("se_slope"))
