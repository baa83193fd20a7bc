"""Evaluation reports: accuracies, breakdowns, repeats, pivots, deltas, gates and sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(correct: Column) -> Column:
    """Share of true values; 0 of nothing."""
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def breakdown(df: DataFrame, correct: Column, *keys: str) -> DataFrame:
    named = [F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("unknown")).alias(k) for k in keys]
    return df.groupBy(*named).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("n_correct"), accuracy(correct).alias("accuracy"))


def grouping_sets(df: DataFrame, correct: Column, keys: list[str]) -> DataFrame:
    """The same measures over each key alone and overall, in one pass: (dimension, bucket, n, accuracy)."""
    pairs = F.array(F.struct(F.lit("all").alias("d"), F.lit("all").alias("b")), *[F.struct(F.lit(k).alias("d"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("b")) for k in keys])
    flat = df.select(correct.cast("double").alias("_c"), F.explode(pairs).alias("_p"))
    return flat.groupBy(F.col("_p.d").alias("dimension"), F.col("_p.b").alias("bucket")).agg(F.count("*").alias("n"), F.coalesce(F.avg("_c"), F.lit(0.0)).alias("accuracy"))


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def repeats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation: 0 of one value, null of none."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n == 1, 0.0).otherwise(F.stddev_pop(value)).alias("std"))


def macro(df: DataFrame, keys: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """One column per name, and their mean where all are there."""
    wide = df.groupBy(*keys).pivot(column, names).agg(F.avg(value))
    present = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names])
    return wide.withColumn("macro", F.when(present, reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names]) / len(names)))


def mode_preferring(df: DataFrame, value: str, wanted: int) -> DataFrame:
    """The most usual value; among equals the wanted one if it is there, else the smallest."""
    c = df.groupBy(value).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), F.desc((F.col(value) == wanted).cast("int")), value).limit(1)


def majority(df: DataFrame, keys: list[str], answer: str, order: str) -> DataFrame:
    """The most frequent answer of each group, the one seen first on ties."""
    votes = df.groupBy(*keys, answer).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct(answer, "votes"), F.struct("votes", -F.col("_first"))).alias("_v")).select(*keys, F.col("_v")[answer].alias(answer), F.col("_v.votes").alias("votes"))


def best(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def gates(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds a boolean per check and `passed`; an unknown measure fails."""
    out = row.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.col(k) for k in checks]))


def delta(df: DataFrame, keys: list[str], column: str, left: str, right: str, value: str) -> DataFrame:
    """left, right and left - right per key; null where one is missing."""
    return df.groupBy(*keys).pivot(column, [left, right]).agg(F.avg(value)).withColumn("delta", F.col(f"`{left}`") - F.col(f"`{right}`"))


def sweep(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Every row under every parameter value: one job instead of one per value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def share_of(df: DataFrame, value: str) -> Column:
    """A row's share of the column's total."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(F.lit(1)))
