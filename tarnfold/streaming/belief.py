"""Beta-Bernoulli beliefs per (problem type, strategy): in batch, as prefixes, and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beliefs(df: DataFrame, keys: list[str], reward: Column, weight: Column | None = None) -> DataFrame:
    """alpha = 1 + sum r, beta = 1 + sum (1 - r), trials, mean. The state is a sum, so any split of the records gives it; works on streams."""
    w = F.lit(1.0) if weight is None else weight
    out = df.groupBy(*keys).agg((1 + F.sum(w * reward)).alias("alpha"), (1 + F.sum(w * (1 - reward))).alias("beta"), F.count(F.lit(1)).alias("trials"))
    return out.withColumn("belief", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def drift(df: DataFrame, keys: list[str], correct: Column, compliance: Column) -> DataFrame:
    """Beliefs in assigned strategies: a record counts as much as it complied with its strategy, and has drifted off it by the rest.

    alpha, beta, trials, drift (mean), usability = belief (1 - drift).
    """
    w, right = clamped(compliance), F.coalesce(correct, F.lit(False)).cast("double")
    out = df.groupBy(*keys).agg((1 + F.sum(w * right)).alias("alpha"), (1 + F.sum(w * (1 - right))).alias("beta"), F.count(F.lit(1)).alias("trials"), F.avg(1 - w).alias("drift"))
    return out.withColumn("usability", F.col("alpha") / (F.col("alpha") + F.col("beta")) * (1 - F.col("drift")))


def credited(df: DataFrame, keys: list[str], correct: Column, strategies: str) -> DataFrame:
    """Beliefs in the strategies that records really used: map<strategy, weight>, each with its weight as credit. strategy, alpha, beta, trials."""
    each = df.select(*keys, F.coalesce(correct, F.lit(False)).cast("double").alias("_right"), F.explode(strategies).alias("strategy", "_weight")).withColumn("_weight", clamped(F.col("_weight")))
    credit = each.groupBy(*keys, "strategy").agg((1 + F.sum(F.col("_weight") * F.col("_right"))).alias("alpha"), (1 + F.sum(F.col("_weight") * (1 - F.col("_right")))).alias("beta"), F.sum("_weight").alias("trials"))
    return credit.withColumn("belief", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def before_each(df: DataFrame, keys: list[str], order: list[Column], reward: Column) -> DataFrame:
    """The belief that held before each record."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    a, b = 1 + F.coalesce(F.sum(reward).over(w), F.lit(0.0)), 1 + F.coalesce(F.sum(1 - reward).over(w), F.lit(0.0))
    return df.withColumn("belief_before", a / (a + b))


def choose(df: DataFrame, type_key: str, strategy: str) -> DataFrame:
    """Per type the strategy with the highest belief; more trials, then the later name, on ties."""
    return df.groupBy(type_key).agg(F.max_by(strategy, F.struct("belief", "trials", strategy)).alias(strategy))


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, length: str, late: str) -> DataFrame:
    """Tumbling windows with a watermark, for streams and batches."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
