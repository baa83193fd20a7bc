"""Quality gates of rollout records: issues, clean rows and groups, drop reasons, the funnel, and reasons across runs.

A gate is a table of codes and conditions; rows, groups and funnels are read from it. Missing flags count as not set, missing texts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.judge import BAD_STRATEGY, CORRECT, ERROR_TYPES, GOOD_EXECUTION, SCORES
from tarnfold.operators import groups as g

Gate = list[tuple[str, Column]]
SECTIONS = ("strategy", "reasoning", "final_answer")


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).rlike(r"^\s*\z")


def number(name: str) -> Column:
    """Whether a value is a finite number."""
    return F.coalesce(g.finite(F.col(name).cast("double")), F.lit(False))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def codes(gate: Gate) -> Column:
    """The codes that hold, in the gate's order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in gate]))


def evidence_gate(least_confidence: float) -> Gate:
    """What speaks against a row as an evidence example. Codes are fixed values."""
    return [
        ("evidence_fallback", flag("evidence_judge_fallback_used")),
        ("format_invalid", ~flag("format_valid")),
        *[(f"{s}_section_missing", ~flag(f"{s}_section_present")) for s in SECTIONS],
        ("judge_parse_failure", F.coalesce(F.size("parse_failure_reasons"), F.lit(0)) > 0),
        ("low_teacher_confidence", F.coalesce("judge_confidence", F.lit(0.0)) < least_confidence),
        *[(f"empty_{s}", blank(f"parsed_{s}")) for s in SECTIONS],
    ]


def prior_group_gate(least_distinct: int) -> Gate:
    """What speaks against a group as a prior example; the conditions are aggregates."""
    return [
        ("prior_fallback", F.some(flag("prior_judge_fallback_used"))),
        ("prior_missing_from_judge", F.some(flag("prior_missing_from_judge"))),
        ("format_invalid", F.some(~flag("format_valid"))),
        ("strategy_section_missing", F.some(~flag("strategy_section_present"))),
        ("empty_strategy", F.some(blank("parsed_strategy"))),
        ("low_suitability_diversity", F.countDistinct(F.coalesce("suitability", F.lit(0))) < least_distinct),
    ]


def drop_gate() -> Gate:
    """Reasons that keep a row from the evidence examples, in the order of the funnel's steps."""
    bad_score = any_of(*[~number(s) for s in SCORES])
    outside = ~bad_score & any_of(*[~F.col(s).between(0, 4) for s in SCORES])
    return [
        ("parse_failure", F.coalesce(F.size("parse_failure_reasons"), F.lit(0)) > 0),
        ("missing_evidence_json", F.col("parsed_judge_json").isNull()),
        ("missing_prior_json", F.col("parsed_prior_judge_json").isNull()),
        ("fallback", flag("prior_judge_fallback_used") | flag("evidence_judge_fallback_used")),
        ("nan_posterior_or_likelihood", ~number("likelihood") | ~number("bayesian_reward")),
        ("nan_prior_probability", ~number("prior_probability")),
        ("missing_score_field", bad_score),
        ("score_out_of_range", outside),
        ("invalid_error_type", ~F.coalesce(F.col("error_type").isin(*ERROR_TYPES), F.lit(False))),
        ("missing_field", ~flag("format_valid") | any_of(*[~flag(f"{s}_section_present") for s in SECTIONS])),
    ]


#: Funnel steps with the reasons that each takes away.
STEPS = [("parse_failed", ("parse_failure", "missing_evidence_json", "missing_prior_json")), ("fallback", ("fallback",)), *[(r, (r,)) for r in ("nan_posterior_or_likelihood", "nan_prior_probability", "missing_score_field", "score_out_of_range", "invalid_error_type", "missing_field")]]


def drop_reasons() -> Column:
    return F.array_sort(codes(drop_gate()))


def clean_row() -> Column:
    """A row that may become an evidence example. (Scores are not looked at here.)"""
    looked_at = {"missing_score_field", "score_out_of_range"}
    return ~any_of(*[c for name, c in drop_gate() if name not in looked_at])


def prior_drop_gate() -> Gate:
    """Reasons that keep a group from the prior examples; the conditions are aggregates."""
    missing = F.some(F.col("suitability").isNull())
    return [
        ("fallback", F.some(flag("prior_judge_fallback_used"))),
        ("missing_field", F.some(~flag("strategy_section_present"))),
        ("missing_score_field", missing),
        ("nan_prior_probability", F.some(~number("prior_probability"))),
        ("parse_failure", F.some(F.col("parsed_prior_judge_json").isNull())),
        ("score_out_of_range", ~missing & F.some(~F.col("suitability").between(0, 4))),
    ]


def clean_group() -> Column:
    """Aggregate: a group that may become a prior example."""
    return F.every(~flag("prior_judge_fallback_used") & F.col("parsed_prior_judge_json").isNotNull() & number("prior_probability"))


def funnel(df: DataFrame) -> DataFrame:
    """(step, removed): rows by the first step that takes them away, `kept` for the rest; one pass."""
    gate, first = dict(drop_gate()), F.lit("kept")
    for step, reasons in reversed(STEPS):
        first = F.when(any_of(*[gate[r] for r in reasons]), step).otherwise(first)
    return df.groupBy(first.alias("step")).agg(F.count("*").alias("removed"))


# Hard cases.


def with_hard_cases(df: DataFrame, comparisons: DataFrame, keys: tuple[str, ...] = ("group_id",), fraction: float = 0.25, ratio: float = 0.9, off_target: tuple[str, ...] = ("wrong_direction", "strategy_mismatch")) -> DataFrame:
    """Adds evidence_tags, prior_tags of a row and posterior_group_tags, prior_group_tags of its group.

    `comparisons` has keys, normalized_predicted_answer and answer_correctness of other runs' tops. Tags are fixed values.
    """
    w = g.group(*keys)
    right, reward = F.col("answer_correctness") == 1, F.col("bayesian_reward")
    t = df.withColumns({"_top": g.first_best(reward, w), "_max": F.max(reward).over(w), "_mixed": F.some(~right).over(w), "_any": F.some(right).over(w), "_priors": F.every(F.col("prior_probability").isNotNull()).over(w)})
    sets = {n: g.fraction_ranks(F.col(c), w, fraction) for n, c in (("prior", "prior_probability"), ("like", "likelihood"))}
    t = t.withColumns({f"_{n}_{side}": c for n, pair in sets.items() for side, c in zip(("high", "low"), pair, strict=True)})
    dear = ~right & (F.col("_max") > 0) & (reward >= ratio * F.col("_max"))
    evidence = [("correct_not_top_reward", right & F.col("_mixed") & (reward < F.col("_max"))), ("incorrect_high_reward", dear), ("off_target_high_reward", dear & F.col("error_type").isin(*off_target))]
    both = [("high_prior_low_likelihood_rollout", "_prior_high", F.col("_like_low")), ("high_prior_wrong_rollout", "_prior_high", ~right), ("low_prior_correct_rollout", "_prior_low", right), ("low_prior_high_likelihood_rollout", "_prior_low", F.col("_like_high"))]
    prior = [(name, F.col("_priors") & F.col(side) & c) for name, side, c in both]
    t = t.withColumns({"evidence_tags": codes(evidence), "prior_tags": codes(prior)})

    top = lambda c: F.max(F.when(F.col("_top"), F.col(c)))
    has = lambda tag: F.some(F.array_contains("evidence_tags", tag))
    whole = t.groupBy(*keys).agg(
        top("normalized_predicted_answer").alias("_answer"),
        top("answer_correctness").alias("_correct"),
        *[has(name).alias(f"_{name}") for name, _ in evidence],
        F.some(F.size("prior_tags") > 0).alias("_conflict"),
        F.first("_any").alias("_a"),
        F.first("_mixed").alias("_m"),
        F.max(F.coalesce("difficulty_bucket", F.lit(""))).alias("_difficulty"),
    )
    others = comparisons.select(*keys, F.coalesce("normalized_predicted_answer", F.lit("")).alias("_other"), F.col("answer_correctness").alias("_theirs"))
    differs = (F.col("_other") != F.coalesce("_answer", F.lit(""))) | (F.col("_theirs") != F.col("_correct"))
    apart = whole.select(*keys, "_answer", "_correct").join(others, list(keys)).groupBy(*keys).agg(F.some(differs).alias("_apart"))
    whole = whole.join(apart, list(keys), "left").withColumn("_apart", flag("_apart"))
    wrong_top = F.col("_correct") == 0
    contested = wrong_top | F.col("_apart") | any_of(*[F.col(f"_{name}") for name, _ in evidence]) | F.col("_conflict") | (F.col("_a") & F.col("_m"))
    group_gate = [
        ("correct_not_top_reward_present", F.col("_correct_not_top_reward")),
        ("incorrect_high_reward_present", F.col("_incorrect_high_reward")),
        ("lambda_selection_disagreement", F.col("_apart")),
        ("medium_reward_conflict", (F.col("_difficulty") == "medium") & contested),
        ("off_target_high_reward_present", F.col("_off_target_high_reward")),
        ("posterior_top_incorrect", wrong_top),
    ]
    whole = whole.select(*keys, codes(group_gate).alias("posterior_group_tags"), codes([("prior_evidence_conflict", F.col("_conflict"))]).alias("prior_group_tags"))
    return t.select(*df.columns, "evidence_tags", "prior_tags").join(whole, list(keys))


# Across runs.


def run_metrics(df: DataFrame, keys: tuple[str, ...] = ("group_id", "run")) -> DataFrame:
    """Per group and run: top_correct (the first highest reward's), mass_on_correct, wrong_top and size."""
    right = F.col("answer_correctness") == 1
    best = F.max_by(F.col("answer_correctness"), F.struct("bayesian_reward", -F.col("rollout_id")))
    out = df.groupBy(*keys).agg(best.alias("top_correct"), F.sum(F.when(right, F.col("bayesian_reward")).otherwise(0.0)).alias("mass_on_correct"), F.some(right).alias("_any"), F.count("*").alias("size"))
    return out.withColumn("wrong_top", F.col("_any") & (F.col("top_correct") == 0)).drop("_any")


def cross_run_reasons(metrics: DataFrame, signals: DataFrame, baseline: int, key: str = "group_id", margin: float = 0.05) -> DataFrame:
    """Per group with a baseline run and another: correction_reasons and retention_reasons, of any other run against it.

    `signals` has the key and an array of its target rows' signals.
    """
    base = metrics.where(F.col("run") == baseline).select(key, F.col("top_correct").alias("_t"), F.col("mass_on_correct").alias("_m"))
    pair = metrics.where(F.col("run") != baseline).join(base, key)
    told = signals.groupBy(key).agg(F.flatten(F.collect_set("signals")).alias("_s"))
    seen = lambda s: F.coalesce(F.array_contains("_s", s), F.lit(False))
    correction = {
        "regression_mass_vs_v0": F.some(F.col("_m") > F.col("mass_on_correct") + margin),
        "regression_top_vs_v0": F.some((F.col("_t") == 1) & (F.col("top_correct") == 0)),
        "wrong_high_posterior": F.some("wrong_top"),
    }
    retention = {
        "retention_mass_vs_v0": F.some(F.col("mass_on_correct") > F.col("_m") + margin),
        "retention_top_vs_v0": F.some((F.col("top_correct") == 1) & (F.col("_t") == 0)),
    }
    out = pair.groupBy(key).agg(*[c.alias(n) for n, c in (correction | retention).items()]).join(told, key, "left")
    known = [(s, seen(s)) for s in ("high_prior_wrong_bad_strategy", "high_prior_wrong_good_execution", "low_prior_correct")]
    return out.select(key, F.array_sort(codes([*known, *[(n, F.col(n)) for n in correction]])).alias("correction_reasons"), codes([(n, F.col(n)) for n in retention]).alias("retention_reasons"))


def family(name: str = "error_type") -> Column:
    """Correct, good strategy badly executed, bad strategy; other types are families of their own."""
    kind = F.coalesce(F.col(name), F.lit(""))
    return F.when(kind.isin(*CORRECT), "correct").when(kind.isin(*GOOD_EXECUTION), "good_strategy_bad_execution").when(kind.isin(*BAD_STRATEGY), "bad_strategy").otherwise(kind)


def common_quality(least_confidence: float) -> Column:
    bad = [flag("evidence_judge_fallback_used"), flag("prior_judge_fallback_used"), ~flag("format_valid"), F.coalesce("judge_confidence", F.lit(0.0)) < least_confidence, *[blank(f"parsed_{s}") for s in SECTIONS]]
    return ~any_of(*bad)


def stable_groups(df: DataFrame, key: str = "group_id", least_confidence: float = 0.5, prior_delta: int = 1, score_delta: int = 1) -> DataFrame:
    """(key, runs, stable): whether a group's runs agree row by row, in order of rollout_id, and all their tops are right.

    Runs have equal sizes; rows in one place are all of common quality, of one family, with priors and scores within deltas (scores: of the first run's).
    """
    t = df.withColumns({"_place": F.row_number().over(g.group(key, "run").orderBy("rollout_id")), "_fine": common_quality(least_confidence), "_family": family()})
    first = g.group(key, "_place").orderBy("run")
    off = any_of(*[F.abs(F.coalesce(s, F.lit(0)) - F.first(F.coalesce(s, F.lit(0))).over(first)) > score_delta for s in SCORES]) | (F.col("_family") != F.first("_family").over(first))
    places = t.withColumn("_off", off).groupBy(key, "_place").agg(F.every("_fine").alias("fine"), F.some("_off").alias("off"), (F.max(F.coalesce("suitability", F.lit(0))) - F.min(F.coalesce("suitability", F.lit(0)))).alias("spread"))
    rows = places.groupBy(key).agg(F.every(F.col("fine") & ~F.col("off") & (F.col("spread") <= prior_delta)).alias("agree"))
    runs = run_metrics(df).groupBy(key).agg(F.count("*").alias("runs"), (F.countDistinct("size") == 1).alias("even"), F.every(F.col("top_correct") == 1).alias("right"))
    return rows.join(runs, key).select(key, "runs", (F.col("agree") & F.col("even") & F.col("right")).alias("stable"))
