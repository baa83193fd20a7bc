"""Per-group analytics: priors, likelihoods, posteriors, advantages, entropies, gaps and ranks, as window columns.

All take the group's columns and work on one shuffle per grouping; a group has to fit in a task's sort, as its members are
compared with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Likelihood weights (fixed values): full reward, first reward, trajectory experiment.
WEIGHTS = {
    "full": {"answer_correctness": 0.80, "step_validity": 0.07, "proof_completeness": 0.08, "strategy_compliance": 0.02, "consistency": 0.03},
    "first": {"answer_correctness": 0.70, "step_validity": 0.10, "proof_completeness": 0.10, "strategy_compliance": 0.05, "consistency": 0.05},
    "trajectory": {"answer_correctness": 0.40, "step_validity": 0.25, "proof_completeness": 0.20, "strategy_compliance": 0.10, "consistency": 0.05},
}


def group(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def mixed_order(c: Column) -> list[Column]:
    """Order keys for ids of mixed kinds: numbers by value, then texts, then nulls."""
    number = F.when(c.rlike(r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(c).cast("double"))
    kind = F.when(c.isNull(), 2).when(number.isNull(), 1).otherwise(0)
    return [kind, number, c]


def softmax(x: Column, w: WindowSpec, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; where any input is not finite, uniform. Temperatures under 1e-8 count as that."""
    e = F.exp((x - F.max(x).over(w)) / max(temperature, 1e-8))
    p = e / F.sum(e).over(w)
    return F.when(F.every(finite(x.cast("double"))).over(w), p).otherwise(1.0 / F.count(F.lit(1)).over(w))


def likelihood(weights: dict[str, float] = WEIGHTS["full"], clamp: bool = True, normalise: bool = False) -> Column:
    """Weighted sum of correctness and the four scores over 4."""
    total = sum(weights.values()) if normalise else 1.0
    terms = [F.lit(v / total) * (F.col(k) if k == "answer_correctness" else F.col(k) / 4.0) for k, v in weights.items()]
    out = reduce(lambda a, b: a + b, terms)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)) if clamp else out


def simple_likelihood(correct_weight: float = 0.8, score_weight: float = 0.2) -> Column:
    mean = (F.col("step_validity") + F.col("proof_completeness") + F.col("strategy_compliance") + F.col("consistency")) / 4.0
    return correct_weight * F.col("answer_correctness") + score_weight * mean / 4.0


def normalise(x: Column, w: WindowSpec) -> tuple[Column, Column]:
    """(x over its group's sum, fallback flag): uniform where any value is bad or negative, or the sum is not positive."""
    bad = F.some(~F.coalesce(finite(x) & (x >= 0), F.lit(False))).over(w)
    total = F.sum(x).over(w)
    fallback = bad | ~F.coalesce(finite(total) & (total > 0), F.lit(False))
    return F.when(fallback, 1.0 / F.count(F.lit(1)).over(w)).otherwise(x / total), fallback


def posterior(prior: Column, like: Column, w: WindowSpec, lam: Column | float = 1.0) -> tuple[Column, Column]:
    """prior ** lam * likelihood, normalised; (posterior, fallback)."""
    return normalise(F.pow(prior, F.lit(lam) if isinstance(lam, float) else lam) * like, w)


def tempered(prior: Column, w: WindowSpec, lam: Column | float) -> Column:
    """prior ** lam, negatives as 0, renormalised over the group."""
    powered = F.pow(F.greatest(prior, F.lit(0.0)), F.lit(lam) if isinstance(lam, float) else lam)
    return normalise(powered, w)[0]


def with_posterior(df: DataFrame, keys: tuple[str, ...] = ("group_id",), weights: dict[str, float] = WEIGHTS["full"], lam: float = 1.0) -> DataFrame:
    """Adds likelihood, prior, posterior and fallback."""
    w = group(*keys)
    out = df.withColumn("likelihood", likelihood(weights)).withColumn("prior", softmax(F.col("suitability").cast("double"), w))
    p, fallback = posterior(F.col("prior"), F.col("likelihood"), w, lam)
    return out.withColumns({"posterior": p, "fallback": fallback})


def first_best(value: Column, w: WindowSpec, index: str = "rollout_id") -> Column:
    """True on the group's highest value, the first by index on ties."""
    return F.row_number().over(w.orderBy(value.desc_nulls_last(), F.col(index))) == 1


def top_index(value: str, index: str = "rollout_id") -> Column:
    """Aggregate: the index of the highest value, the lowest index on ties."""
    return F.max_by(F.col(index), F.struct(F.col(value), -F.col(index)))


def entropy(p: Column, mode: str = "natural") -> Column:
    """Aggregate. natural: -sum p ln p; smoothed: with ln(p + 1e-12); scaled: over ln n; renormalised: of p over its sum, scaled."""
    if mode == "smoothed":
        return -F.sum(p * F.log(p + 1e-12))
    plain = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    if mode == "natural":
        return plain
    n = F.count(F.lit(1))
    if mode == "renormalised":
        total = F.sum(F.greatest(p, F.lit(0.0)))
        plain = F.when(total > 0, F.log(total) - F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)) / total).otherwise(0.0)
    return F.when(n > 1, plain / F.log(n.cast("double"))).otherwise(0.0)


def gap(p: Column, singleton: str = "value") -> Column:
    """Aggregate: largest minus second value; of a single value, itself or 0."""
    v = F.sort_array(F.collect_list(p), asc=False)
    return F.when(F.size(v) > 1, v[0] - v[1]).otherwise(v[0] if singleton == "value" else F.lit(0.0))


def centred(x: Column, w: WindowSpec) -> Column:
    return x - F.avg(x).over(w)


def leave_one_out(x: Column, w: WindowSpec) -> Column:
    """(r - mean) n / (n - 1); of a single one r - mean."""
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, centred(x, w) * n / (n - 1)).otherwise(centred(x, w))


def standardised(x: Column, w: WindowSpec, floor: float = 1e-8) -> Column:
    return centred(x, w) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))


def logp_reward(total: Column, length: Column, mode: str = "sum_exp", lo: float = -80.0) -> Column:
    """sum_exp, mean_exp: e to the (mean) log probability, clamped to [lo, 0]; sum, mean: itself."""
    x = total if mode.startswith("sum") else total / F.greatest(length, F.lit(1))
    return F.exp(F.greatest(F.least(x, F.lit(0.0)), F.lit(lo))) if mode.endswith("exp") else x


def _unit_sums(df: DataFrame, keys: tuple[str, ...], vector: str) -> DataFrame:
    """(keys, _i, _s): sums of unit vectors by group and component, added up within each Arrow batch first, so few rows are shuffled."""
    given = df.select(*keys, F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            named = pd.DataFrame({str(i): b.column(i).to_pandas() for i in range(len(keys))})
            code = named.groupby(list(named.columns), dropna=False, sort=False).ngroup().to_numpy()
            v = b.column("_v")
            flat, lengths = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                x = flat[(ends[rows] - n)[:, None] + np.arange(n)]
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                usable = norm > 0  # not where a component is null
                unit = np.where(usable, x / np.where(usable, norm, 1), 0.0)
                groups, first, at = np.unique(code[rows], return_index=True, return_inverse=True)
                sums = np.zeros((len(groups), n))
                np.add.at(sums, at, unit)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows[first])).columns[: len(keys)], pa.array(sums.tolist(), pa.list_(pa.float64()))], [*keys, "_v"])

    parts = given.mapInArrow(run, given.schema)
    return parts.select(*keys, F.posexplode("_v").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_s"))


def diversity(df: DataFrame, keys: tuple[str, ...], vector: str, eps: float = 1e-6, size: int | None = None) -> DataFrame:
    """Adds diversity_weight = 1 / (sum of cosines with the group, itself included, + eps). With a size, groups of fewer rows are incomplete: weight 1.

    The sum of dot products is the dot product with the group's sum: one aggregation, no pairs.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sums = _unit_sums(df, keys, vector).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias("_sum"))
    unit = df.withColumn("_norm", norm).withColumn("_u", F.transform(vector, lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(0.0)))
    dot = F.aggregate(F.zip_with("_u", "_sum", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    weight = 1.0 / (dot + eps)
    out = unit.join(sums, list(keys), "left")
    if size is not None:
        weight = F.when(F.col("_rows") >= size, weight).otherwise(1.0)
        out = out.join(df.groupBy(*keys).agg(F.count("*").alias("_rows")), list(keys))
    return out.withColumn("diversity_weight", weight).drop("_u", "_norm", "_sum", "_rows")


def fraction_ranks(value: Column, w: WindowSpec, fraction: float, index: str = "rollout_id") -> tuple[Column, Column]:
    """(in the top, in the bottom) k = max(1, ceil(n * fraction)) of the group in ascending order, later indices after earlier ones; fraction is clamped to [0, 0.5]."""
    f = max(0.0, min(0.5, fraction))
    k = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * f))
    return F.row_number().over(w.orderBy(value.desc(), F.col(index).desc())) <= k, F.row_number().over(w.orderBy(value.asc(), F.col(index))) <= k


def metrics(df: DataFrame, keys: tuple[str, ...] = ("group_id",), p: str = "posterior", index: str = "rollout_id") -> DataFrame:
    """The bundle of group metrics: size, correctness, top-1 by posterior, mass on correct, entropy, gap, wrong_top."""
    correct = F.col("answer_correctness") >= 1
    best = F.max_by(F.col("answer_correctness"), F.struct(F.col(p), -F.col(index)))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.some(correct).alias("any_correct"),
        (best >= 1).alias("top_correct"),
        F.sum(F.when(correct, F.col(p)).otherwise(0.0)).alias("mass_on_correct"),
        entropy(F.col(p), "scaled").alias("entropy"),
        gap(F.col(p), "zero").alias("top_gap"),
    )
    return out.withColumn("wrong_top", F.col("any_correct") & ~F.col("top_correct"))
