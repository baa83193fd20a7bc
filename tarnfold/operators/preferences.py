"""Preference pairs of judgments: chosen is the teacher's; rejected a learned one where there is one that differs, else a perturbed one.

Learned judgments are looked up by problem and rollout, the last row winning. A pair with a learned reject gets a perturbed companion with a given
probability, by a hash of its id. Both sides are JSON with sorted keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.judge import SCORES
from tarnfold.operators.curate import hash_uniform
from tarnfold.operators.examples import evidence_target, score, simple_evidence_target, simple_prior_target, unit


class Bend(NamedTuple):
    """How a judgment is bent: what it is added to the scores and to the confidence, its new label, what it says, and its style."""

    when: Column
    scores: tuple[int, int, int, int]
    confidence: float
    error_type: str | None
    reason: str
    style: str


def bends(right: Column) -> list[Bend]:
    """In order of precedence. Amounts, labels, sentences and styles."""
    tagged = lambda t: F.array_contains("hard_case_tags", t)
    conflict = tagged("posterior_top1_wrong") | tagged("medium_reward_conflict")
    return [
        Bend(tagged("wrong_high_likelihood"), (1, 1, 1, 1), 0.35, "finalization_error", "Overcredits an incorrect but plausible-looking rollout.", "wrong_but_plausible_high_likelihood"),
        Bend(tagged("correct_low_likelihood"), (-1, -2, -1, -1), -0.35, "correct_weak_proof", "Underrates a correct rollout despite mostly valid reasoning.", "correct_but_underrated"),
        Bend(tagged("wrong_high_prior"), (1, 0, 2, 0), 0.25, "valid_but_incomplete", "Lets high prior bias leak into evidence confidence.", "high_prior_wrong_reward_leakage"),
        Bend(tagged("correct_low_prior"), (0, 0, -2, 0), -0.25, None, "Underrates a correct rollout because the strategy looked less promising.", "low_prior_correct_underrated"),
        Bend(conflict & ~right, (1, 1, 0, 0), 0.2, "valid_but_incomplete", "Creates a misleading near-miss judgment that can steal posterior mass.", "posterior_conflict_wrong_boosted"),
        Bend(conflict & right, (0, -1, 0, 0), -0.2, "correct_weak_proof", "Shaves confidence off the correct rollout in a conflicted group.", "posterior_conflict_correct_underrated"),
        Bend(right, (-1, -1, -1, -1), -0.2, "correct_weak_proof", "Undervalues a valid rollout.", "generic_correct_underrated"),
        Bend(F.lit(True), (1, 1, 1, 1), 0.2, "finalization_error", "Reward leakage: overrates an incorrect rollout.", "generic_wrong_overrated"),
    ]


def bent(target: Column, reason: str, confidence: str, right: Column) -> tuple[Column, Column]:
    """(the target bent by the first rule that holds, its style). `reason` and `confidence`: the fields that hold these."""
    rules = bends(right)

    def first(value) -> Column:  # noqa: ANN001
        out = F.lit(None)
        for rule in reversed(rules):
            out = F.when(rule.when, value(rule)).otherwise(out)
        return out

    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(4), c)).cast("int")
    fields = {s: clamp(target[s] + first(lambda rule, i=i: F.lit(rule.scores[i]))) for i, s in enumerate(SCORES)}
    fields["error_type"] = F.coalesce(first(lambda rule: F.lit(rule.error_type)), target["error_type"])
    fields[confidence] = unit(target[confidence] + first(lambda rule: F.lit(rule.confidence)))
    fields[reason] = first(lambda rule: F.lit(rule.reason))
    out = target
    for name, value in fields.items():
        out = out.withField(name, value)
    return out, first(lambda rule: F.lit(rule.style))


def with_learned(df: DataFrame, learned: DataFrame, order: str, tasks: int | None = None) -> DataFrame:
    """Adds `learned`: the last learned row (by `order`) of the record's problem and rollout, null where there is none. Both sides are dealt to `tasks`, or as the session does."""
    key = lambda: F.concat_ws(":", F.sha2("problem", 256), F.col("rollout_id").cast("string"))
    dealt = lambda t: t.repartition(tasks, "_key") if tasks else t
    last = dealt(learned.withColumn("_key", key())).groupBy("_key").agg(F.max_by(F.struct(*learned.columns), order).alias("learned"))
    return dealt(df.withColumn("_key", key())).join(last, "_key", "left").drop("_key")


def sorted_json(c: Column, names: list[str]) -> Column:
    return F.to_json(F.struct(*[c[n].alias(n) for n in sorted(names)]))


def _pairs(df: DataFrame, prefix: str, task: str, chosen: Column, candidate: Column, made: tuple[Column, Column], ident: Column, companions: float, seed: int) -> DataFrame:
    """pair_id, split, task, bucket_name, group_id, rollout_id, chosen, rejected, rejected_source, rejected_style."""
    t = df.select("*", F.concat(F.lit(f"{prefix}:"), ident).alias("pair_id"), chosen.alias("chosen"), candidate.alias("_theirs"), made[0].alias("_made"), made[1].alias("_style"))
    side = lambda text, source, style, suffix: F.struct(text.alias("rejected"), F.lit(source).alias("rejected_source"), style.alias("rejected_style"), F.lit(suffix).alias("suffix"))
    real = side(F.col("_theirs"), "learned_sft", F.lit("real_learned_mistake"), "")
    made_up = lambda suffix: side(F.col("_made"), "synthetic", F.col("_style"), suffix)
    differs = F.coalesce(F.col("_theirs") != F.col("chosen"), F.lit(False))
    extra = (hash_uniform(F.concat_ws("|", F.lit(str(seed)), "pair_id")) < companions) & (F.col("_made") != F.col("chosen"))
    rejects = F.when(differs & extra, F.array(real, made_up(":synthetic"))).when(differs, F.array(real)).otherwise(F.array(made_up("")))
    bucket = F.coalesce(F.try_element_at("hard_case_tags", F.lit(1)), F.lit("clean"))
    out = t.select("pair_id", "split", F.lit(task).alias("task"), bucket.alias("bucket_name"), "group_id", "rollout_id", "chosen", F.explode(rejects).alias("r"))
    return out.select(F.concat("pair_id", "r.suffix").alias("pair_id"), "split", "task", "bucket_name", "group_id", "rollout_id", "chosen", "r.rejected", "r.rejected_source", "r.rejected_style")


RECORD = ["group_id", "rollout_id"]


def evidence_pairs(df: DataFrame, kind: str, companions: float, seed: int) -> DataFrame:
    """Of rows with hard_case_tags, split and learned: struct with the scores, error_type and likelihood. kind: simple or runtime."""
    simple = kind == "simple"
    reason, confidence = ("brief_reason", "likelihood_score") if simple else ("key_weakness", "judge_confidence")
    target = simple_evidence_target() if simple else evidence_target()
    t = df.withColumn("_t", target)
    names = t.schema["_t"].dataType.fieldNames()
    theirs = F.col("_t")
    for s in SCORES:
        theirs = theirs.withField(s, score(F.coalesce(F.col(f"learned.{s}"), F.col(f"_t.{s}"))))
    theirs = theirs.withField("error_type", F.coalesce(F.nullif("learned.error_type", F.lit("")), "_t.error_type"))
    theirs = theirs.withField(confidence, unit(F.coalesce("learned.likelihood", f"_t.{confidence}")))
    theirs = theirs.withField(reason, F.lit("SFT analyzer evidence judgment.") if simple else F.coalesce(F.nullif("_t.key_weakness", F.lit("")), F.lit("SFT analyzer disagreement.")))
    made, style = bent(F.col("_t"), reason, confidence, F.col("answer_correctness") == 1)
    candidate = F.when(F.col("learned").isNotNull(), sorted_json(theirs, names))
    return _pairs(t, f"{kind}-evidence", "evidence_judge", sorted_json(F.col("_t"), names), candidate, (sorted_json(made, names), style), F.concat_ws(":", *RECORD), companions, seed)


# What is said of a prior judgment that is too low, too high, or pushed to an end.
LOW = ("low_prior_on_teacher_high_prior", "Undervalues a strategy that looks directly applicable.")
HIGH = ("high_prior_on_teacher_low_prior", "Overrates a vague or weak strategy.")
POLAR = ("polarized_prior_misjudge", "Polarizes a borderline strategy instead of judging it cautiously.")


def misjudged(s: Column, odd: Column) -> tuple[Column, Column, Column]:
    """(wrong score, style, reason): two off towards the other end; a score of 2 goes to an end by a bit."""
    pick = lambda k: F.when(s >= 3, LOW[k]).when(s <= 1, HIGH[k]).otherwise(POLAR[k])
    return F.when(s >= 3, s - 2).when(s <= 1, s + 2).otherwise(F.when(odd, 4).otherwise(0)), pick(0), pick(1)


def prior_pairs(df: DataFrame, companions: float, seed: int) -> DataFrame:
    """Of single prior judgments in one score. Rows have hard_case_tags, split and learned.suitability."""
    t = df.withColumns({"_t": simple_prior_target(), "_id": F.concat_ws(":", *RECORD)})
    names = t.schema["_t"].dataType.fieldNames()
    odd = F.conv(F.substring(F.sha2("_id", 256), 1, 1), 16, 10).cast("int") % 2 == 1
    new, style, reason = misjudged(F.col("_t.prior_score"), odd)
    scored = lambda c, value: c.withField("prior_score", value).withField("strategy_relevance", value).withField("problem_fit", value)
    risk = F.col("_t.risk_of_error")
    made = scored(F.col("_t"), new.cast("int")).withField("risk_of_error", F.when(new >= 3, F.least(risk, F.lit(1))).when(new <= 1, F.greatest(risk, F.lit(3))).otherwise(4 - new).cast("int")).withField("brief_reason", reason)
    theirs = score(F.coalesce("learned.suitability", "_t.prior_score"))
    candidate = scored(F.col("_t"), theirs).withField("risk_of_error", (4 - theirs).cast("int")).withField("brief_reason", F.lit("SFT analyzer prior judgment."))
    return _pairs(t, "simple-prior", "prior_judge", sorted_json(F.col("_t"), names), F.when(F.col("learned").isNotNull(), sorted_json(candidate, names)), (sorted_json(made, names), style), F.col("_id"), companions, seed)


def runtime_prior_pairs(df: DataFrame, companions: float, seed: int) -> DataFrame:
    """Of whole groups: one pair for each rollout in focus (lowest and highest score, the middle one), in which that one is misjudged.

    A learned reject needs learned scores of all rollouts, one of which differs. The rollouts of a group fit in a row.
    """
    w, ordered = Window.partitionBy("group_id"), Window.partitionBy("group_id").orderBy("rollout_id")
    low = Window.partitionBy("group_id").orderBy(F.coalesce("suitability", F.lit(0)), "rollout_id")
    n = F.count(F.lit(1)).over(w)
    focus = (F.row_number().over(low) == 1) | (F.row_number().over(low) == n) | (F.row_number().over(ordered) == F.floor(n / 2) + 1)
    t = df.withColumns({"_focus": focus, "_s": score(F.col("suitability")), "_l": F.when(F.col("learned").isNotNull(), score(F.coalesce("learned.suitability", "suitability")))})
    prior = lambda s, reason, flag: F.struct(reason.alias("reason"), flag.alias("risk_flag"), F.col("rollout_id").cast("int").alias("rollout_id"), s.cast("int").alias("suitability"))
    own = prior(F.col("_s"), F.coalesce("prior_reason", F.lit("")), F.coalesce("risk_flag", F.lit("")))
    theirs = prior(F.col("_l"), F.lit("SFT analyzer prior judgment."), F.when(F.col("_l") >= 2, "").otherwise("risky"))
    new, style, reason = misjudged(F.col("_s"), F.col("rollout_id") % 2 == 1)
    flag = F.when(F.col("_s") >= 3, "too_risky").when(F.col("_s") <= 1, "none").otherwise(F.when(new == 0, "too_risky").otherwise("none"))
    each = t.select("group_id", "rollout_id", "split", "hard_case_tags", "group_hard_case_tags", "_focus", own.alias("own"), theirs.alias("theirs"), prior(new, reason, flag).alias("made"), style.alias("style"), (F.col("_l") != F.coalesce("suitability", F.lit(-1))).alias("moved"), F.col("_l").isNull().alias("gap"))
    item = lambda c: F.array_sort(F.collect_list(F.struct(F.col("rollout_id").alias("i"), F.col(c).alias("x"))))
    groups = each.groupBy("group_id").agg(item("own").alias("own"), item("theirs").alias("theirs"), (F.some("moved") & ~F.some("gap")).alias("learned"), F.first("split").alias("split"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("hard_case_tags")))).alias("hard_case_tags"), F.collect_list(F.when(F.col("_focus"), F.struct("rollout_id", "made", "style"))).alias("focus"))
    t = groups.select("*", F.explode("focus").alias("f")).withColumn("rollout_id", F.col("f.rollout_id"))
    listed = lambda items: F.to_json(F.struct(items.alias("priors")))
    plain = lambda c: F.transform(c, lambda p: p["x"])
    made = F.transform("own", lambda p: F.when(p["i"] == F.col("rollout_id"), F.col("f.made")).otherwise(p["x"]))
    return _pairs(t, "runtime-prior", "prior_judge", listed(plain("own")), F.when(F.coalesce("learned", F.lit(False)), listed(plain("theirs"))), (listed(made), F.col("f.style")), F.concat_ws(":", *RECORD), companions, seed)
