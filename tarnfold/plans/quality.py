"""Queries of quality gates, hard cases and cross-run reasons (P7-P12, L1, L2, L5, L6), on debug columns derived from the tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators import gates as gt
from tarnfold.operators import groups as g
from tarnfold.operators import labels as lb
from tarnfold.plans.base import ROLL, query, rollouts
from tarnfold.plans.labels import SIG, post

DEBUG = ROLL.replace("l_suppkey % 3 AS run,", "l_suppkey % 3 AS run, l_partkey AS part, l_discount AS disc,") + """, dbg AS (SELECT * REPLACE (round(likelihood, 9) AS likelihood), part % 23 = 0 AS evidence_judge_fallback_used, part % 29 = 0 AS prior_judge_fallback_used,
  part % 31 = 0 AS prior_missing_from_judge, CASE WHEN part % 37 <> 0 THEN part % 7 <> 0 END AS format_valid, part % 13 <> 0 AS strategy_section_present, part % 17 <> 0 AS reasoning_section_present, part % 19 <> 0 AS final_answer_section_present,
  part % 11 = 0 AS judge_failed, CASE WHEN part % 41 <> 0 THEN round(disc * 10, 2) END AS judge_confidence, CASE WHEN part % 43 = 0 THEN '  ' WHEN part % 47 <> 0 THEN 'add' END AS parsed_strategy,
  CASE WHEN part % 53 = 0 THEN '' ELSE 'step' END AS parsed_reasoning, CASE WHEN part % 59 = 0 THEN ' ' ELSE CAST(part % 3 AS VARCHAR) END AS parsed_final_answer, part % 61 <> 0 AS evidence_json, part % 67 <> 0 AS prior_json,
  CASE WHEN part % 71 <> 0 THEN round(prior, 9) END AS prior_probability, round(posterior, 9) AS bayesian_reward, CAST(part % 3 AS VARCHAR) AS normalized_predicted_answer, CASE WHEN problem_type = '3-MEDIUM' THEN 'medium' ELSE 'hard' END AS difficulty_bucket FROM post)
"""


def debug(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts with the flags, texts and judge outputs of a debug log."""
    part = F.col("part")
    every = lambda n: part % n == 0
    parsed = lambda n: F.when(~every(n), F.struct(part.alias("part")))
    t = g.with_posterior(rollouts(spark, d, F.col("l_partkey").alias("part"), F.col("l_discount").alias("disc")))
    return t.withColumns({
        "likelihood": F.round("likelihood", 9),
        "evidence_judge_fallback_used": every(23),
        "prior_judge_fallback_used": every(29),
        "prior_missing_from_judge": every(31),
        "format_valid": F.when(~every(37), ~every(7)),
        "strategy_section_present": ~every(13),
        "reasoning_section_present": ~every(17),
        "final_answer_section_present": ~every(19),
        "parse_failure_reasons": F.when(every(11), F.array(F.lit("json_decode_error"))).otherwise(F.array().cast("array<string>")),
        "judge_confidence": F.when(~every(41), F.round(F.col("disc") * 10, 2)),
        "parsed_strategy": F.when(every(43), "  ").when(~every(47), "add"),
        "parsed_reasoning": F.when(every(53), "").otherwise("step"),
        "parsed_final_answer": F.when(every(59), " ").otherwise((part % 3).cast("string")),
        "parsed_judge_json": parsed(61),
        "parsed_prior_judge_json": parsed(67),
        "prior_probability": F.when(~every(71), F.round("prior", 9)),
        "bayesian_reward": F.round("posterior", 9),
        "normalized_predicted_answer": (part % 3).cast("string"),
        "difficulty_bucket": F.when(F.col("problem_type") == "3-MEDIUM", "medium").otherwise("hard"),
    })


def _list(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


OFF = {s: f"NOT {s}_section_present" for s in ("strategy", "reasoning", "final_answer")}
EMPTY = {s: f"trim(coalesce(parsed_{s}, '')) = ''" for s in OFF}
ISSUES = _list([("evidence_fallback", "evidence_judge_fallback_used"), ("format_invalid", "NOT coalesce(format_valid, false)"), *[(f"{s}_section_missing", c) for s, c in OFF.items()], ("judge_parse_failure", "judge_failed"), ("low_teacher_confidence", "coalesce(judge_confidence, 0) < 0.3"), *[(f"empty_{s}", c) for s, c in EMPTY.items()]])


@query("p7_row_issues", DEBUG + f"SELECT group_id, rollout_id, array_to_string({ISSUES}, ',') AS issues FROM dbg")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return debug(spark, d).select("group_id", "rollout_id", F.array_join(gt.codes(gt.evidence_gate(0.3)), ",").alias("issues"))


GROUP_ISSUES = _list([("prior_fallback", "bool_or(prior_judge_fallback_used)"), ("prior_missing_from_judge", "bool_or(prior_missing_from_judge)"), ("format_invalid", "bool_or(NOT coalesce(format_valid, false))"), ("strategy_section_missing", f"bool_or({OFF['strategy']})"), ("empty_strategy", f"bool_or({EMPTY['strategy']})"), ("low_suitability_diversity", "count(DISTINCT suitability) < 3")])


@query("p8_p10_group_gate", DEBUG + f"SELECT group_id, array_to_string({GROUP_ISSUES}, ',') AS issues, bool_and(NOT prior_judge_fallback_used AND prior_json AND prior_probability IS NOT NULL) AS clean FROM dbg GROUP BY 1")
def p8(spark: SparkSession, d: str) -> DataFrame:
    t = debug(spark, d).groupBy("group_id")
    return t.agg(F.array_join(gt.codes(gt.prior_group_gate(3)), ",").alias("issues"), gt.clean_group().alias("clean"))


#: The log with damage of every kind: scores and suitabilities that are missing or out of range, likelihoods that are no numbers, unknown labels.
DAMAGED = DEBUG + """, dam AS (SELECT * REPLACE (CASE WHEN part % 73 = 0 THEN NULL WHEN part % 101 = 0 THEN 9 ELSE suitability END AS suitability, CASE WHEN part % 79 <> 0 THEN step_validity END AS step_validity,
  CASE WHEN part % 83 = 0 THEN 7 ELSE consistency END AS consistency, CASE WHEN part % 89 = 0 THEN 'NaN'::DOUBLE ELSE likelihood END AS likelihood, CASE WHEN part % 97 = 0 THEN 'typo' ELSE error_type END AS error_type) FROM dbg)
"""


def damaged(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("part")
    return debug(spark, d).withColumns({
        "suitability": F.when(part % 73 == 0, F.lit(None)).when(part % 101 == 0, 9).otherwise(F.col("suitability")),
        "step_validity": F.when(part % 79 != 0, F.col("step_validity")),
        "consistency": F.when(part % 83 == 0, 7).otherwise(F.col("consistency")),
        "likelihood": F.when(part % 89 == 0, float("nan")).otherwise(F.col("likelihood")),
        "error_type": F.when(part % 97 == 0, "typo").otherwise(F.col("error_type")),
    })


CLEAN = "NOT evidence_judge_fallback_used AND NOT prior_judge_fallback_used AND NOT judge_failed AND evidence_json AND prior_json AND coalesce(format_valid, false) AND strategy_section_present AND reasoning_section_present AND final_answer_section_present AND NOT isnan(likelihood) AND error_type <> 'typo' AND prior_probability IS NOT NULL"


@query("p9_clean_rows", DAMAGED + f"SELECT group_id, rollout_id FROM dam WHERE {CLEAN}")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return damaged(spark, d).where(gt.clean_row()).select("group_id", "rollout_id")


FIELD = f"NOT coalesce(format_valid, false) OR {' OR '.join(OFF.values())}"
OUTSIDE = "step_validity IS NOT NULL AND consistency = 7"
ROW_DROPS = _list([("fallback", "prior_judge_fallback_used OR evidence_judge_fallback_used"), ("invalid_error_type", "error_type = 'typo'"), ("missing_evidence_json", "NOT evidence_json"), ("missing_field", FIELD), ("missing_prior_json", "NOT prior_json"), ("missing_score_field", "step_validity IS NULL"), ("nan_posterior_or_likelihood", "isnan(likelihood)"), ("nan_prior_probability", "prior_probability IS NULL"), ("parse_failure", "judge_failed"), ("score_out_of_range", OUTSIDE)])
GROUP_DROPS = _list([("fallback", "bool_or(prior_judge_fallback_used)"), ("missing_field", f"bool_or({OFF['strategy']})"), ("missing_score_field", "bool_or(suitability IS NULL)"), ("nan_prior_probability", "bool_or(prior_probability IS NULL)"), ("parse_failure", "bool_or(NOT prior_json)"), ("score_out_of_range", "bool_or(suitability = 9) AND NOT bool_or(suitability IS NULL)")])


@query("p11_drop_reasons", DAMAGED + f", x AS (SELECT 'row' AS kind, {ROW_DROPS} AS r FROM dam UNION ALL SELECT 'group', {GROUP_DROPS} FROM dam GROUP BY group_id), y AS (SELECT kind, unnest(r) AS reason, r[1] AS first FROM x) SELECT kind, reason, count(*) AS n, count(*) FILTER (reason = first) AS n_primary FROM y GROUP BY 1, 2")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of rows and groups; a row's primary reason is its alphabetically first."""
    t = damaged(spark, d)
    rows = t.select(F.lit("row").alias("kind"), gt.drop_reasons().alias("r"))
    whole = t.groupBy("group_id").agg(gt.codes(gt.prior_drop_gate()).alias("r")).select(F.lit("group"), "r")
    each = rows.union(whole).select("kind", F.explode("r").alias("reason"), F.get("r", F.lit(0)).alias("first"))
    return each.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == F.col("first")).alias("n_primary"))


@query("p12_funnel", DAMAGED + f"SELECT CASE WHEN judge_failed OR NOT evidence_json OR NOT prior_json THEN 'parse_failed' WHEN prior_judge_fallback_used OR evidence_judge_fallback_used THEN 'fallback' WHEN isnan(likelihood) THEN 'nan_posterior_or_likelihood' WHEN prior_probability IS NULL THEN 'nan_prior_probability' WHEN step_validity IS NULL THEN 'missing_score_field' WHEN {OUTSIDE} THEN 'score_out_of_range' WHEN error_type = 'typo' THEN 'invalid_error_type' WHEN {FIELD} THEN 'missing_field' ELSE 'kept' END AS step, count(*) AS removed FROM dam GROUP BY 1")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return gt.funnel(damaged(spark, d))


TAGS = {
    "evidence_tags": _list([("correct_not_top_reward", "answer_correctness = 1 AND mixed AND bayesian_reward < best_reward"), ("incorrect_high_reward", "dear"), ("off_target_high_reward", "dear AND error_type IN ('wrong_direction', 'strategy_mismatch')")]),
    "prior_tags": _list([("high_prior_low_likelihood_rollout", "pp AND ph <= k AND ll <= k"), ("high_prior_wrong_rollout", "pp AND ph <= k AND answer_correctness = 0"), ("low_prior_correct_rollout", "pp AND pl <= k AND answer_correctness = 1"), ("low_prior_high_likelihood_rollout", "pp AND pl <= k AND lh <= k")]),
}
HARD = DEBUG + f""", w AS (SELECT *, max(bayesian_reward) OVER o AS best_reward, bool_or(answer_correctness = 0) OVER o AS mixed, bool_or(answer_correctness = 1) OVER o AS anyc, bool_and(prior_probability IS NOT NULL) OVER o AS pp, greatest(1, ceil(count(*) OVER o * 0.25)) AS k,
  row_number() OVER (PARTITION BY group_id ORDER BY bayesian_reward DESC, rollout_id) AS rk, row_number() OVER (PARTITION BY group_id ORDER BY prior_probability DESC, rollout_id DESC) AS ph, row_number() OVER (PARTITION BY group_id ORDER BY prior_probability, rollout_id) AS pl,
  row_number() OVER (PARTITION BY group_id ORDER BY likelihood DESC, rollout_id DESC) AS lh, row_number() OVER (PARTITION BY group_id ORDER BY likelihood, rollout_id) AS ll FROM dbg WINDOW o AS (PARTITION BY group_id)),
v AS (SELECT *, answer_correctness = 0 AND best_reward > 0 AND bayesian_reward >= 0.9 * best_reward AS dear FROM w), r AS (SELECT *, {TAGS['evidence_tags']} AS evidence_tags, {TAGS['prior_tags']} AS prior_tags FROM v),
c AS (SELECT group_id, normalized_predicted_answer AS a, answer_correctness AS ok FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY bayesian_reward DESC, rollout_id) AS place FROM dbg WHERE run = 1) WHERE place = 1),
t AS (SELECT group_id, max(CASE WHEN rk = 1 THEN normalized_predicted_answer END) AS a, max(CASE WHEN rk = 1 THEN answer_correctness END) AS ok, bool_or(list_contains(evidence_tags, 'incorrect_high_reward')) AS e1, bool_or(list_contains(evidence_tags, 'correct_not_top_reward')) AS e2,
  bool_or(list_contains(evidence_tags, 'off_target_high_reward')) AS e3, bool_or(len(prior_tags) > 0) AS p, bool_or(anyc AND mixed) AS both_kinds, max(difficulty_bucket) AS diff FROM r GROUP BY 1),
h AS (SELECT t.*, coalesce(c.a <> t.a OR c.ok <> t.ok, false) AS apart FROM t LEFT JOIN c USING (group_id)),
z AS (SELECT group_id, {_list([("correct_not_top_reward_present", "e2"), ("incorrect_high_reward_present", "e1"), ("lambda_selection_disagreement", "apart"), ("medium_reward_conflict", "diff = 'medium' AND (ok = 0 OR apart OR e1 OR e2 OR e3 OR p OR both_kinds)"), ("off_target_high_reward_present", "e3"), ("posterior_top_incorrect", "ok = 0")])} AS q, {_list([("prior_evidence_conflict", "p")])} AS s FROM h)
"""


def hard_cases(spark: SparkSession, d: str) -> DataFrame:
    t = debug(spark, d)
    other = t.where("run = 1").groupBy("group_id").agg(F.max_by(F.struct("normalized_predicted_answer", "answer_correctness"), F.struct("bayesian_reward", -F.col("rollout_id"))).alias("m")).select("group_id", "m.*")
    return gt.with_hard_cases(t, other)


HARD_COLUMNS = ("evidence_tags", "prior_tags", "posterior_group_tags", "prior_group_tags")


@query("l1_hard_case_tags", HARD + "SELECT group_id, rollout_id, array_to_string(evidence_tags, ',') AS evidence_tags, array_to_string(prior_tags, ',') AS prior_tags, array_to_string(q, ',') AS posterior_group_tags, array_to_string(s, ',') AS prior_group_tags FROM r JOIN z USING (group_id)")
def l1(spark: SparkSession, d: str) -> DataFrame:
    return hard_cases(spark, d).select("group_id", "rollout_id", *[F.array_join(c, ",").alias(c) for c in HARD_COLUMNS])


#: Tags of dbg's rollouts and groups; ranks by likelihood, suitability and reward.
TAGGED = DEBUG + """, rk AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY group_id) * 0.25)) AS k, row_number() OVER (PARTITION BY group_id ORDER BY likelihood DESC, rollout_id DESC) AS ld, row_number() OVER (PARTITION BY group_id ORDER BY likelihood, rollout_id) AS la,
  row_number() OVER (PARTITION BY group_id ORDER BY suitability DESC, rollout_id DESC) AS sd, row_number() OVER (PARTITION BY group_id ORDER BY suitability, rollout_id) AS sa, row_number() OVER (PARTITION BY group_id ORDER BY bayesian_reward DESC, rollout_id) AS best FROM dbg),
gt AS (SELECT group_id, bool_or(answer_correctness = 1) AND bool_or(best = 1 AND answer_correctness = 0) AS missed, bool_or(answer_correctness = 1) AND bool_or(answer_correctness = 0) AND (bool_or(best = 1 AND answer_correctness = 0) OR bool_or(answer_correctness = 0 AND ld <= k)) AS conflict FROM rk GROUP BY 1),
tg AS (SELECT rk.*, list_filter([CASE WHEN conflict THEN 'medium_reward_conflict' END, CASE WHEN missed THEN 'posterior_top1_wrong' END], lambda x: x IS NOT NULL) AS group_tags,
  list_filter([CASE WHEN answer_correctness = 1 AND la <= k THEN 'correct_low_likelihood' END, CASE WHEN answer_correctness = 1 AND sa <= k THEN 'correct_low_prior' END, CASE WHEN conflict THEN 'medium_reward_conflict' END, CASE WHEN missed THEN 'posterior_top1_wrong' END,
  CASE WHEN answer_correctness = 0 AND ld <= k THEN 'wrong_high_likelihood' END, CASE WHEN answer_correctness = 0 AND sd <= k THEN 'wrong_high_prior' END], lambda x: x IS NOT NULL) AS tags FROM rk JOIN gt USING (group_id))
"""


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return lb.with_tags(debug(spark, d), reward="bayesian_reward")


@query("l2_rollout_tags", TAGGED + "SELECT group_id, rollout_id, array_to_string(tags, ',') AS tags, array_to_string(group_tags, ',') AS group_tags FROM tg")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("group_id", "rollout_id", F.array_join("hard_case_tags", ",").alias("tags"), F.array_join("group_hard_case_tags", ",").alias("group_tags"))


RUN_METRICS = """(SELECT group_id, run, arg_max(answer_correctness, -rk) AS ok, coalesce(sum(CASE WHEN answer_correctness = 1 THEN bayesian_reward END), 0) AS mass, bool_or(answer_correctness = 1) AS anyc, count(*) AS size
  FROM (SELECT *, row_number() OVER (PARTITION BY group_id, run ORDER BY bayesian_reward DESC, rollout_id) AS rk FROM {}) GROUP BY 1, 2)"""


@query("l5_cross_run_reasons", SIG + f""", u AS (SELECT *, posterior AS bayesian_reward FROM s), m AS {RUN_METRICS.format("u")}, b AS (SELECT a.*, z.ok AS ok0, z.mass AS mass0 FROM m a JOIN m z ON z.group_id = a.group_id AND z.run = 0 WHERE a.run <> 0),
x AS (SELECT group_id, bool_or(list_contains(signals, 'high_prior_wrong_bad_strategy')) AS s1, bool_or(list_contains(signals, 'high_prior_wrong_good_execution')) AS s2, bool_or(list_contains(signals, 'low_prior_correct')) AS s3 FROM s WHERE run <> 0 GROUP BY 1)
SELECT group_id, array_to_string({_list([("high_prior_wrong_bad_strategy", "any_value(s1)"), ("high_prior_wrong_good_execution", "any_value(s2)"), ("low_prior_correct", "any_value(s3)"), ("regression_mass_vs_v0", "bool_or(mass0 > mass + 0.05)"), ("regression_top_vs_v0", "bool_or(ok0 = 1 AND ok = 0)"), ("wrong_high_posterior", "bool_or(anyc AND ok = 0)")])}, ',') AS correction_reasons,
  array_to_string({_list([("retention_mass_vs_v0", "bool_or(mass > mass0 + 0.05)"), ("retention_top_vs_v0", "bool_or(ok = 1 AND ok0 = 0)")])}, ',') AS retention_reasons FROM b LEFT JOIN x USING (group_id) GROUP BY 1""")
def l5(spark: SparkSession, d: str) -> DataFrame:
    t = lb.with_signals(post(spark, d)).withColumn("bayesian_reward", F.col("posterior"))
    out = gt.cross_run_reasons(gt.run_metrics(t), t.where("run <> 0").select("group_id", "signals"), 0)
    return out.select("group_id", F.array_join("correction_reasons", ",").alias("correction_reasons"), F.array_join("retention_reasons", ",").alias("retention_reasons"))


FAMILY = "CASE WHEN error_type LIKE '%correct%' THEN 'correct' WHEN error_type IN ('finalization_error', 'arithmetic_error') THEN 'good' ELSE 'bad' END"


@query("l6_stable_groups", DEBUG + f""", q AS (SELECT *, row_number() OVER (PARTITION BY group_id, run ORDER BY rollout_id) AS i, {FAMILY} AS fam, NOT evidence_judge_fallback_used AND NOT prior_judge_fallback_used AND coalesce(format_valid, false) AND coalesce(judge_confidence, 0) >= 0.1
  AND trim(coalesce(parsed_strategy, '')) <> '' AND trim(parsed_reasoning) <> '' AND trim(parsed_final_answer) <> '' AS fine FROM dbg),
f AS (SELECT *, abs(step_validity - first_value(step_validity) OVER o) > 2 OR abs(proof_completeness - first_value(proof_completeness) OVER o) > 2 OR abs(strategy_compliance - first_value(strategy_compliance) OVER o) > 2 OR abs(consistency - first_value(consistency) OVER o) > 2 OR fam <> first_value(fam) OVER o AS off
  FROM q WINDOW o AS (PARTITION BY group_id, i ORDER BY run)),
p AS (SELECT group_id, i, bool_and(fine) AND NOT bool_or(off) AND max(suitability) - min(suitability) <= 2 AS agree FROM f GROUP BY 1, 2), a AS (SELECT group_id, bool_and(agree) AS agree FROM p GROUP BY 1),
m AS (SELECT group_id, count(*) AS runs, count(DISTINCT size) = 1 AND bool_and(ok = 1) AS good FROM {RUN_METRICS.format("dbg")} GROUP BY 1) SELECT group_id, runs, agree AND good AS stable FROM a JOIN m USING (group_id)""")
def l6(spark: SparkSession, d: str) -> DataFrame:
    return gt.stable_groups(debug(spark, d), least_confidence=0.1, prior_delta=2, score_delta=2)
