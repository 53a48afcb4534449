"""Walk-forward evaluation: every prediction comes from a model of earlier seasons."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretime.operators.pit import day_sums


def fold_table(meta: DataFrame, purge_days: int = 7, least: float = 0.1) -> DataFrame:
    """season, first, train_until of the seasons to predict: all but the first, and not those with under least of the median size. Training takes earlier seasons and days before train_until."""
    by = meta.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))
    size = by.agg(F.median("n").alias("median"), F.min("season").alias("earliest")).first()  # one row
    if size["median"] is None:
        return by.select("season", "first", F.date_sub("first", purge_days).alias("train_until"))
    return by.filter((F.col("season") > size["earliest"]) & (F.col("n") >= max(1.0, least * size["median"]))).select("season", "first", F.date_sub("first", purge_days).alias("train_until"))


def assign_folds(meta: DataFrame, purge_days: int = 7) -> DataFrame:
    """A row for each fold and row of meta with part train or validate; folds are a row for each season."""
    folds = F.broadcast(fold_table(meta, purge_days).select(F.col("season").alias("fold"), "train_until"))
    part = F.when(F.col("season") == F.col("fold"), "validate").when((F.col("season") < F.col("fold")) & (F.col("date") < F.col("train_until")), "train")
    return meta.join(folds, F.col("season") <= F.col("fold")).withColumn("part", part).filter("part IS NOT NULL").drop("train_until")


def _each_fold(df: DataFrame, purge_days: int):
    for f in sorted(fold_table(df, purge_days).collect()):  # a row for each season
        yield f["season"], df.filter((F.col("season") < f["season"]) & (F.col("date") < F.lit(f["train_until"]))), df.filter(F.col("season") == f["season"])


def walk_forward_logistic(df: DataFrame, features: list[str], label: str, purge_days: int = 7, reg: float = 0.01) -> DataFrame:
    """df's predictable seasons with fold and p, by a standardised logistic regression for each fold."""
    data, out = VectorAssembler(inputCols=features, outputCol="__raw").transform(df), []
    for fold, train, validate in _each_fold(data, purge_days):
        scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(train)
        model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=reg).fit(scaler.transform(train))
        p = model.transform(scaler.transform(validate)).withColumn("p", F.element_at(vector_to_array("probability"), 2))
        out.append(p.select(*df.columns, F.lit(fold).alias("fold"), "p"))
    return reduce(DataFrame.unionByName, out)


def walk_forward_poisson(df: DataFrame, features: list[str], label: str, base_rate: str, purge_days: int = 7, reg: float = 0.01, low: float = 0.4, high: float = 8.0) -> DataFrame:
    """df's predictable seasons with fold and rate: a Poisson regression whose offset is the log of a base rate, so it learns what to add to it."""
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(df.withColumn("__offset", F.ln(base_rate)))
    out = []
    for fold, train, validate in _each_fold(data, purge_days):
        glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="__x", labelCol=label, offsetCol="__offset", regParam=reg)
        p = glm.fit(train).transform(validate).withColumn("rate", F.greatest(F.least("prediction", F.lit(high)), F.lit(low)))
        out.append(p.select(*df.columns, F.lit(fold).alias("fold"), "rate"))
    return reduce(DataFrame.unionByName, out)


def market_logit(p: Column, available: Column) -> Column:
    """The logit of a fair price clipped to (0.02, 0.98); 0 where there is none."""
    q = F.greatest(F.least(p, F.lit(0.98)), F.lit(0.02))
    return F.when(available, F.ln(q / (1 - q))).otherwise(F.lit(0.0))


def temperature(df: DataFrame, logit: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one column."""
    m = LogisticRegression(featuresCol="__x", labelCol=label).fit(VectorAssembler(inputCols=[logit], outputCol="__x").transform(df))
    return float(m.coefficients[0]), float(m.intercept)


def core_and_tail(df: DataFrame, date: str, tail: float = 0.15) -> DataFrame:
    """part core or tail: the last days that hold about a tail of the rows. Days, not rows, are split, from counts by day."""
    by = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each day
    ahead = by.withColumn("__cum", F.sum("__n").over(Window.orderBy(date))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    parts = ahead.select(date, F.when(F.col("__cum") <= (1 - tail) * F.col("__all"), "core").otherwise("tail").alias("part"))
    return df.join(parts, date)


def with_drift(df: DataFrame, adjustment: str, prior_rows: float = 25.0) -> DataFrame:
    """df (season, date) with shift: the sum of same-season adjustments on strictly earlier days, over their number plus prior_rows. The window runs over sums by day, not over rows."""
    out = day_sums(df, ["season"], "date", [adjustment], {"before": (None, -1)})
    return out.withColumn("shift", F.coalesce(f"{adjustment}_sum_before", F.lit(0.0)) / (F.coalesce(f"{adjustment}_n_before", F.lit(0)) + F.lit(prior_rows))).drop(f"{adjustment}_sum_before", f"{adjustment}_n_before")
