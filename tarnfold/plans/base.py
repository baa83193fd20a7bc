"""Registration of queries with their oracle SQL, and the rollout view that the fixture tables give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lineitems that a task should hold at most.
ROWS = 1 << 18


def tasks(spark: SparkSession, t: DataFrame) -> int | None:
    """How many tasks the rows ask for, but not fewer than the session deals to, as a join would then deal anew; none for a table of a few."""
    n = -(-t.count() // ROWS)
    return None if n < 4 else max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, t: DataFrame, key: str) -> DataFrame:
    """Dealt by key to as many tasks as its rows ask for, so that a task's sorts and hash tables don't grow with the table. What follows by this key, or by more columns, is not dealt again."""
    n = tasks(spark, t)
    return t if n is None else t.repartition(n, key)


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def rollouts(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """One row per rollout: group_id, rollout_id, scores, error_type, problem_type and run (FIXTURES.md, part C), and further columns of lineitem."""
    li, o = dealt(spark, table(spark, sf_dir, "lineitem"), "l_orderkey"), table(spark, sf_dir, "orders")
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    correct = F.col("l_returnflag") == "R"
    step = (F.round(F.col("l_discount") * 100).cast("int") % 5).cast("int")
    suit = F.col("l_quantity").cast("int") % 5
    error = (
        F.when(correct, F.when(step >= 3, "correct_complete").when(step == 2, "correct_weak_proof").otherwise("lucky_correct"))
        .when(F.col("l_linestatus") == "F", F.when(step >= 2, "finalization_error").otherwise("wrong_direction"))
        .otherwise(F.when(step >= 2, "arithmetic_error").otherwise("no_meaningful_solution"))
    )
    rows = li.select(
        F.col("l_orderkey").alias("group_id"),
        (F.row_number().over(w) - 1).alias("rollout_id"),
        correct.cast("double").alias("answer_correctness"),
        suit.alias("suitability"),
        step.alias("step_validity"),
        (F.round(F.col("l_tax") * 100).cast("int") % 5).alias("proof_completeness"),
        suit.alias("strategy_compliance"),
        (F.col("l_partkey") % 5).cast("int").alias("consistency"),
        error.alias("error_type"),
        (F.col("l_suppkey") % 3).cast("int").alias("run"),
        *more,
    )
    return rows.join(o.select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("problem_type")), "group_id")


ROLL = """WITH roll AS (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rollout_id,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answer_correctness, CAST(trunc(l_quantity) AS INT) % 5 AS suitability, CAST(round(l_discount * 100) AS INT) % 5 AS step_validity,
  CAST(round(l_tax * 100) AS INT) % 5 AS proof_completeness, CAST(trunc(l_quantity) AS INT) % 5 AS strategy_compliance, l_partkey % 5 AS consistency, l_suppkey % 3 AS run,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN CAST(round(l_discount * 100) AS INT) % 5 >= 3 THEN 'correct_complete' WHEN CAST(round(l_discount * 100) AS INT) % 5 = 2 THEN 'correct_weak_proof' ELSE 'lucky_correct' END
    WHEN l_linestatus = 'F' THEN CASE WHEN CAST(round(l_discount * 100) AS INT) % 5 >= 2 THEN 'finalization_error' ELSE 'wrong_direction' END
    ELSE CASE WHEN CAST(round(l_discount * 100) AS INT) % 5 >= 2 THEN 'arithmetic_error' ELSE 'no_meaningful_solution' END END AS error_type,
  o_orderpriority AS problem_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
lik AS (SELECT *, least(1.0, greatest(0.0, 0.80 * answer_correctness + 0.07 * step_validity / 4.0 + 0.08 * proof_completeness / 4.0 + 0.02 * strategy_compliance / 4.0 + 0.03 * consistency / 4.0)) AS likelihood,
  exp(suitability - max(suitability) OVER g) / sum(exp(suitability - mx)) OVER g AS prior FROM (SELECT *, max(suitability) OVER (PARTITION BY group_id) AS mx FROM roll) WINDOW g AS (PARTITION BY group_id)),
post AS (SELECT *, CASE WHEN sum(prior * likelihood) OVER g > 0 THEN prior * likelihood / sum(prior * likelihood) OVER g ELSE 1.0 / count(*) OVER g END AS posterior,
  sum(prior * likelihood) OVER g <= 0 AS fallback, count(*) OVER g AS n FROM lik WINDOW g AS (PARTITION BY group_id))
"""
