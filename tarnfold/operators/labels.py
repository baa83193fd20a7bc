"""Label data: signals and tags of hard cases, correction targets, prior corrections, examples and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.judge import BAD_STRATEGY, GOOD_EXECUTION, SCORES
from tarnfold.operators import groups as g

#: (error types, step, proof, strategy, consistency): correction targets of wrong rollouts; the first that holds an error type counts. Fixed values.
TARGETS = [
    (("wrong_direction",), (0, 0, 0, 1)),
    (("invalid_assumption",), (1, 1, 1, 1)),
    (("strategy_mismatch",), (1, 1, 0, 1)),
    (("finalization_error",), (3, 3, 4, 3)),
    (("valid_but_incomplete", "arithmetic_error", "algebraic_error"), (2, 2, 3, 2)),
    (("format_error",), (1, 1, 1, 1)),
]
#: (lowest, highest) of each score for correct rollouts, by error type; others are treated as lucky. Fixed values.
CORRECT_BOUNDS = {"correct_complete": ((4, 4), (4, 4), (4, 4), (4, 4)), "correct_weak_proof": ((3, 4), (2, 4), (3, 4), (3, 4)), "lucky_correct": ((2, 3), (1, 2), (1, 2), (2, 3))}
#: Signals by priority with the sampling bucket of each: of preference pairs, and of calibration data.
PAIR_PRIORITY = [("wrong_high_posterior_top", "wrong_top_correction"), ("correct_available_but_not_top", "wrong_top_correction"), ("low_prior_correct", "low_prior_correct"), ("high_prior_wrong_bad_strategy", "high_prior_wrong"), ("high_prior_wrong_good_execution", "good_strategy_bad_execution")]
CALIBRATION_PRIORITY = [PAIR_PRIORITY[2], PAIR_PRIORITY[3], PAIR_PRIORITY[4], PAIR_PRIORITY[0], PAIR_PRIORITY[1]]


def family(error_type: Column) -> Column:
    return F.when(error_type.isin(*BAD_STRATEGY), "bad_strategy").when(error_type.isin(*GOOD_EXECUTION), "good_execution").when(error_type.startswith("correct") | (error_type == "lucky_correct"), "correct").otherwise("other")


def with_signals(df: DataFrame, keys: tuple[str, ...] = ("group_id",), low: int = 1, high: int = 3, high_likelihood: float = 0.8, low_likelihood: float = 0.3) -> DataFrame:
    """Adds `signals`: what is telling about a rollout within its group, in alphabetical order. Needs likelihood, posterior and suitability."""
    w = g.group(*keys)
    right = F.col("answer_correctness") == 1
    top = g.first_best(F.col("posterior"), w)
    missed = F.some(right).over(w) & F.some(F.col("_top") & ~right).over(w)
    cheap = right & (F.col("suitability") <= low) & (F.col("likelihood") >= high_likelihood)
    dear = ~right & (F.col("suitability") >= high) & (F.col("likelihood") <= low_likelihood)
    kind = family(F.col("error_type"))
    codes = {
        "correct_available_but_not_top": F.col("_missed") & right,
        "high_prior_wrong_bad_strategy": dear & (kind == "bad_strategy"),
        "high_prior_wrong_good_execution": dear & (kind == "good_execution"),
        "high_prior_wrong_other": dear & ~kind.isin("bad_strategy", "good_execution"),
        "low_prior_correct": cheap & F.col("error_type").isin("correct_complete", "correct_weak_proof"),
        "low_prior_lucky_correct": cheap & (F.col("error_type") == "lucky_correct"),
        "wrong_high_posterior_top": F.col("_missed") & F.col("_top") & ~right,
    }
    out = df.withColumn("_top", top).withColumn("_missed", missed)
    return out.withColumn("signals", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes.items()]))).drop("_top", "_missed")


def bucket(signals: Column, priority: list[tuple[str, str]] = PAIR_PRIORITY) -> Column:
    return F.coalesce(*[F.when(F.array_contains(signals, s), F.lit(b)) for s, b in priority], F.lit(None).cast("string"))


def with_tags(df: DataFrame, keys: tuple[str, ...] = ("group_id",), fraction: float = 0.25, reward: str = "posterior") -> DataFrame:
    """Adds group_hard_case_tags, and hard_case_tags of a rollout, its group's among them, sorted.

    A rollout: wrong among the likeliest or most trusted, correct among the least. A group: some are right but not the first best by
    reward; or some are right and some wrong, and so is the best, or one of the likeliest is wrong.
    """
    w = g.group(*keys)
    tops = {n: g.fraction_ranks(F.col(n), w, fraction) for n in ("likelihood", "suitability")}
    right = F.col("answer_correctness") == 1
    flags = {"_likely": tops["likelihood"][0], "_unlikely": tops["likelihood"][1], "_trusted": tops["suitability"][0], "_mistrusted": tops["suitability"][1], "_best": g.first_best(F.col(reward), w)}
    t = df.withColumns(flags)
    some = lambda c: F.some(c).over(w)
    missed = some(right) & some(F.col("_best") & ~right)
    t = t.withColumns({"_missed": missed, "_conflict": some(right) & some(~right) & (missed | some(~right & F.col("_likely")))})
    own = [("correct_low_likelihood", right & F.col("_unlikely")), ("correct_low_prior", right & F.col("_mistrusted")), ("wrong_high_likelihood", ~right & F.col("_likely")), ("wrong_high_prior", ~right & F.col("_trusted"))]
    shared = [("medium_reward_conflict", F.col("_conflict")), ("posterior_top1_wrong", F.col("_missed"))]
    held = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return t.withColumns({"group_hard_case_tags": held(shared), "hard_case_tags": F.array_sort(held([*own, *shared]))}).drop(*flags, "_missed", "_conflict")


def correction() -> Column:
    """Struct of the four corrected scores by correctness and error type."""
    right, kind = F.col("answer_correctness") == 1, F.col("error_type")

    def one(i: int) -> Column:
        lucky = CORRECT_BOUNDS["lucky_correct"][i]
        clamp = lambda b: F.greatest(F.lit(b[0]), F.least(F.lit(b[1]), F.col(SCORES[i])))
        good = F.when(kind == "correct_complete", clamp(CORRECT_BOUNDS["correct_complete"][i])).when(kind == "correct_weak_proof", clamp(CORRECT_BOUNDS["correct_weak_proof"][i])).otherwise(clamp(lucky))
        bad = F.lit(0)
        for kinds, scores in reversed(TARGETS):
            bad = F.when(kind.isin(*kinds), scores[i]).otherwise(bad)
        return F.when(right, good).otherwise(bad)

    return F.struct(*[one(i).alias(s) for i, s in enumerate(SCORES)])


def corrected_prior(signals: Column) -> Column:
    """Suitability raised to 3 where a sound correct one was mistrusted, capped where a bad strategy was trusted."""
    raised = F.when(F.array_contains(signals, "low_prior_correct"), F.greatest(F.col("suitability"), F.lit(3))).otherwise(F.col("suitability"))
    cap = F.when(F.col("error_type") == "strategy_mismatch", 2).otherwise(1)
    return F.when(F.array_contains(signals, "high_prior_wrong_bad_strategy"), F.least(raised, cap)).otherwise(raised)


def perturbed(score: Column, by: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), score + by))


def pairs(df: DataFrame, chosen: Column, rejected: Column, *keys: str) -> DataFrame:
    """Preference pairs as JSON; equal sides are no pair."""
    return df.select(*keys, F.to_json(chosen).alias("chosen"), F.to_json(rejected).alias("rejected")).where("chosen <> rejected")


def group_examples(df: DataFrame, clean: Column, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """One row per group whose rollouts are all clean, with its candidates in order."""
    packed = df.withColumn("_clean", clean).groupBy(*keys).agg(F.every("_clean").alias("_ok"), F.array_sort(F.collect_list(F.struct("rollout_id", "suitability"))).alias("candidates"))
    return packed.where("_ok").select(*keys, F.size("candidates").alias("num_rollouts"), "candidates")
