"""Training examples from rollout records: targets, evidence and prior examples, hard cases, preference pairs and their mixture.

Names of tasks, fields, styles and tiers are fixed values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.judge import SCORES
from tarnfold.operators.curate import dense_index, hash_order, hash_split, kept, packed, short_order, unpacked
from tarnfold.operators.sampling import chosen_per, copies, passes, ratios

TEXTS = ("key_strength", "key_weakness", "critical_failure_step")


def score(c: Column) -> Column:
    """An integer from 0 to 4; null is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.coalesce(c.cast("int"), F.lit(0))))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def filled(default: str, *names: str) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names], F.lit(default))


def evidence_target() -> Column:
    """What the evidence judge should answer."""
    return F.struct(*[score(F.col(s)).alias(s) for s in SCORES], filled("format_error", "error_type").alias("error_type"), *[F.coalesce(t, F.lit("")).alias(t) for t in TEXTS], unit(F.col("judge_confidence")).alias("judge_confidence"))


def simple_evidence_target() -> Column:
    return F.struct(F.col("answer_correctness").cast("int").alias("answer_correctness"), *[score(F.col(s)).alias(s) for s in SCORES], filled("format_error", "error_type").alias("error_type"), unit(F.col("likelihood")).alias("likelihood_score"), filled("Teacher evidence judgment.", "key_weakness", "key_strength", "critical_failure_step").alias("brief_reason"))


def simple_prior_target(suitability: Column | None = None) -> Column:
    """A prior judgment in one score; risk is at least what the score leaves, and 2 where a flag is raised."""
    s = score(F.col("suitability") if suitability is None else suitability)
    flagged = F.when(F.coalesce(F.trim("risk_flag"), F.lit("")).isin("", "none", "low"), 0).otherwise(2)
    return F.struct(s.alias("strategy_relevance"), s.alias("problem_fit"), F.greatest(flagged, 4 - s).alias("risk_of_error"), s.alias("prior_score"), filled("Teacher prior judgment.", "prior_reason").alias("brief_reason"))


def prior_targets() -> Column:
    """Aggregate: the group's priors in order of rollout_id."""
    one = F.struct(F.col("rollout_id").cast("int").alias("rollout_id"), score(F.col("suitability")).alias("suitability"), F.coalesce("prior_reason", F.lit("")).alias("reason"), F.coalesce("risk_flag", F.lit("")).alias("risk_flag"))
    return F.array_sort(F.collect_list(one))


def provenance(source: str, label: str) -> list[Column]:
    return [F.lit(source).alias("source_file"), F.lit(label).alias("label_source"), F.sha2("problem", 256).alias("problem_key")]


def evidence_id() -> Column:
    """A hash of what an evidence example asks and of its answer."""
    return F.sha2(F.to_json(F.struct("problem", *[F.coalesce(f"parsed_{s}", F.lit("")).alias(s) for s in ("strategy", "reasoning", "final_answer")], "answer_correctness", evidence_target().alias("target"))), 256)


def prior_id() -> Column:
    """A hash of a group's problem and priors."""
    return F.sha2(F.to_json(F.struct("problem", "priors")), 256)


def evidence_examples(df: DataFrame, tier: str, source: str, held: float = 0.1) -> DataFrame:
    """One per row; its id is a hash of what it asks and of its answer, its split one of its problem."""
    tags = [F.array_sort("evidence_tags").alias("hard_case_tags")] if "evidence_tags" in df.columns else []
    return df.select(evidence_id().alias("example_id"), F.lit("evidence_judge").alias("task"), hash_split(F.col("problem"), held).alias("split"), F.lit(tier).alias("quality_tier"), *provenance(source, "teacher_trace"), F.struct("group_id", "rollout_id").alias("group_key"), evidence_target().alias("teacher_target"), *tags)


def prior_examples(df: DataFrame, tier: str, source: str, held: float = 0.1) -> DataFrame:
    """One per group."""
    tags = [F.array_sort(F.flatten(F.array(F.first("prior_group_tags"), F.array_distinct(F.flatten(F.collect_list("prior_tags")))))).alias("hard_case_tags")] if "prior_tags" in df.columns else []
    whole = df.groupBy("group_id", "problem").agg(F.count("*").alias("num_rollouts"), prior_targets().alias("priors"), *tags)
    return whole.select(prior_id().alias("example_id"), F.lit("prior_judge").alias("task"), hash_split(F.col("problem"), held).alias("split"), F.lit(tier).alias("quality_tier"), *provenance(source, "teacher_trace"), "group_id", "num_rollouts", "priors", *[F.col("hard_case_tags") for _ in tags])


def example_ids(df: DataFrame, good: Column, clean: Column, held: float = 0.1) -> DataFrame:
    """(group_id, task, example_id, split) of the evidence examples of rows that are `good` and the prior examples of groups that are `clean` (an aggregate), from one pass over the groups."""
    whole = df.groupBy("group_id", "problem").agg(F.collect_list(F.when(good, evidence_id())).alias("_ids"), prior_targets().alias("priors"), clean.alias("_clean"))
    one = lambda task, x: F.struct(F.lit(task).alias("task"), x.alias("example_id"))
    prior = F.when(F.col("_clean"), F.array(one("prior", prior_id()))).otherwise(F.array().cast("array<struct<task:string,example_id:string>>"))
    each = whole.select("group_id", hash_split(F.col("problem"), held).alias("split"), F.explode(F.concat(F.transform("_ids", lambda x: one("evidence", x)), prior)).alias("_e"))
    return each.select("group_id", "_e.task", "_e.example_id", "split")


def hard_case_examples(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, prior, posterior) hard cases of rows with tags (gates.with_hard_cases). A posterior case is a group with its rollouts."""
    named = ["group_id", "rollout_id", "problem", *[f"parsed_{s}" for s in ("strategy", "reasoning", "final_answer")], "answer_correctness", *SCORES, "error_type", *TEXTS, "judge_confidence", "suitability", "prior_reason", "risk_flag", "bayesian_reward"]
    tagged = ["evidence_tags", "prior_tags", "posterior_group_tags", "prior_group_tags"]
    some = reduce(lambda a, b: a | b, [F.coalesce(F.size(c) > 0, F.lit(False)) for c in tagged if c != "prior_tags"])
    df = kept(df.where(some).select(*dict.fromkeys([*named, *tagged])), "hard")  # made once for the three
    evidence = evidence_examples(df.where(F.size("evidence_tags") > 0), "hard_case", source)
    prior = prior_examples(df.where(F.size("prior_group_tags") > 0), "hard_case", source)
    rollout = F.struct("rollout_id", "answer_correctness", "bayesian_reward", "evidence_tags")
    posterior = df.where(F.size("posterior_group_tags") > 0).groupBy("group_id", "problem").agg(F.first("posterior_group_tags").alias("hard_case_tags"), F.array_sort(F.collect_list(rollout)).alias("rollouts"))
    return evidence, prior, posterior


def mixture(evidence: DataFrame, prior: DataFrame, weights: dict[str, float], seed: int, most: int | None = None) -> DataFrame:
    """One training set of (task, example_id, pass, instance, place): both pools in the weights' ratio, in whole reshuffled passes.

    As many rows as use the pool that is scarce for its weight wholly, unless `most` says otherwise. `place` orders the shuffled mixture.
    """
    pools = evidence.select(F.lit("evidence").alias("task"), "example_id").unionByName(prior.select(F.lit("prior").alias("task"), "example_id"))
    pools = _numbered(pools.withColumn("source", F.lit(None).cast("string")))  # counts, cuts and passes all read it
    out = _mixed(pools, weights, seed, most)
    return out.select(_example().alias("example_id"), "pass", "instance", "task", _place(seed).alias("place"))


def _numbered(pools: DataFrame, near: tuple[str, ...] = ()) -> DataFrame:
    """Pools (task, source, example_id, others) as a table with short ids, numbered copies and rows."""
    ids = copies(pools.withColumn("_id", packed(F.col("example_id"))), ["task", "source", "_id"], near)
    return kept(ids.drop("example_id", *near).withColumn("row", F.monotonically_increasing_id()), "pools")


def _example() -> Column:
    return unpacked(F.col("_id"))


def _place(seed: int) -> Column:
    """An example of two sources is two."""
    return hash_order(seed, F.col("task"), F.concat_ws("|", "source", _example()), F.col("instance"))


def _mixed(pools: DataFrame, weights: dict[str, float], seed: int, most: int | None) -> DataFrame:
    """(task, source, _id, row, pass, instance) of numbered pools: what `mixture` says, without the order."""
    share = ratios(weights)
    counts = {r.task: r.n for r in pools.groupBy("task").agg(F.count("*").alias("n")).collect()}  # two tasks
    n = {k: counts.get(k, 0) for k in ("evidence", "prior")}
    total = most if most is not None else math.ceil(max((n[k] / share[k] for k in n if share.get(k, 0) > 0), default=0))
    wanted = {"evidence": round(total * share["evidence"])}
    wanted["prior"] = total - wanted["evidence"]
    columns = ["task", "source", "_id", "row", "_copies", "_copy"]
    parts = [passes(pools.where(F.col("task") == k).select(columns), wanted[k], seed, F.concat_ws("|", "source", _example()), n[k], "source", "_id") for k in n]
    return parts[0].unionByName(parts[1])


def assemble(pools: DataFrame, sources: list[str], weights: dict[str, float], seed: int, most: int | None = None, near: tuple[str, ...] = ()) -> DataFrame:
    """A mixture of several sources per task, with its validation set, of pools (task, source, split, example_id): task, source, example_id, split (train or val), index.

    Sources of a task are one pool, in which an example of two sources is two. Training rows are indexed in the shuffled mixture's order; validation is the
    plain union, indexed by task and source, in the order of `sources`. `near`: columns of the pools that rows of one example share; they lie by these.
    """
    places, examples = assembled(pools, sources, weights, seed, most, near)
    return places.join(examples, "row").select("task", "source", "example_id", "split", "index")


def assembled(pools: DataFrame, sources: list[str], weights: dict[str, float], seed: int, most: int | None = None, near: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """`assemble` as places (task, source, split, row, index) and examples (row, example_id), so that a mixture of many passes holds no ids."""
    pools = _numbered(pools.select("task", "source", "split", "example_id", *near), near)
    mixed = _mixed(pools.where(F.col("split") == "train"), weights, seed, most)
    mixed = dense_index(mixed.select("task", "source", "row", short_order(_place(seed)).alias("_o")), [F.col("_o"), F.col("task")], "index", ("_o",))
    rank = reduce(lambda c, kv: F.when(F.col("source") == kv[1], kv[0]).otherwise(c), enumerate(sources), F.lit(len(sources)))
    held = pools.where(F.col("split") == "val").select("task", "source", "row", _example().alias("_e"))
    held = dense_index(held, [F.col("task"), rank, F.col("_e")], "index", ("_e",))
    both = mixed.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("val")))
    return both.select("task", "source", "split", "row", "index"), pools.select("row", _example().alias("example_id"))


def allocate(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole parts of total * share, and one more for the largest fractions, earlier buckets first on ties."""
    exact = {k: total * r for k, r in shares.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    left = total - sum(out.values())
    for k in sorted(shares, key=lambda k: exact[k] - out[k], reverse=True)[:left]:
        out[k] += 1
    return out


def bucket_mixture(pools: DataFrame, shares: dict[str, float], weights: dict[str, float], seed: int, most: int | None = None, near: tuple[str, ...] = ()) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """(training set, rows allocated) of pools (task, bucket, example_id): tasks by weight, in each the buckets by share. An example counts once in a pool.

    Without `most`, as many rows as use the pool that is scarcest for its part wholly. A pool is used in whole reshuffled passes and a part of one; all
    pools are sampled in one plan. Adds pass and index, a dense position in the shuffled set. A part that falls to an empty pool is an error.
    `near`: columns of the pools that rows of one example share; rows that lie by them aren't dealt anew.
    """
    places, examples, parts = bucket_places(pools, shares, weights, seed, most, near)
    return places.join(examples.select("row", "example_id"), "row").select("task", "bucket", "example_id", "pass", "index"), parts


def bucket_places(pools: DataFrame, shares: dict[str, float], weights: dict[str, float], seed: int, most: int | None = None, near: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], int]]:
    """`bucket_mixture` as places (task, bucket, row, pass, index) and examples (task, bucket, row, example_id), so that a mixture of many passes holds no ids."""
    pools = pools.select("task", "bucket", packed(F.col("example_id")).alias("_id"), *near).dropDuplicates(["task", "bucket", *near, "_id"])
    pools = kept(pools.drop(*near).withColumn("row", F.monotonically_increasing_id()), "pools")
    task_share, share = ratios(weights), ratios(shares)
    sizes = {(r.task, r.bucket): r.n for r in pools.groupBy("task", "bucket").agg(F.count("*").alias("n")).collect()}  # tasks x buckets
    wanted = [sizes[t, b] / max(1e-9, task_share[t] * share[b]) for t in weights for b in shares if sizes.get((t, b)) and share[b] > 0]
    total = most if most is not None else math.ceil(max(wanted, default=0))
    first, *others = weights
    if len(others) != 1:
        raise ValueError("two tasks are mixed")
    rows = {first: round(total * task_share[first])}
    rows[others[0]] = total - rows[first]
    parts = {(t, b): n for t in weights for b, n in allocate(rows[t], share).items()}
    if empty := [k for k, n in parts.items() if n > 0 and not sizes.get(k)]:
        raise ValueError(f"nothing to sample from in {empty}")
    key = F.concat_ws("|", "task", "bucket")
    plan = [(f"{t}|{b}", -(-n // sizes[t, b]), n - (-(-n // sizes[t, b]) - 1) * sizes[t, b]) for (t, b), n in parts.items() if n > 0]
    quotas = pools.sparkSession.createDataFrame(plan, "_pool string, _passes int, quota long")
    each = pools.withColumn("_pool", key).join(F.broadcast(quotas.drop("quota")), "_pool")
    whole = each.where("_passes > 1").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_passes") - 2)))
    last = each.withColumn("pass", F.col("_passes") - 1).withColumn("_h", hash_order(seed, F.col("task"), F.col("bucket"), F.col("pass"), _example()))
    cut = chosen_per(last, quotas.drop("_passes"), "_pool", "_h", "_id").where("_chosen")
    order = short_order(hash_order(seed, F.lit("place"), F.col("task"), F.col("bucket"), F.col("pass"), _example()))
    columns = ["task", "bucket", "row", "pass", order.alias("_o")]
    places = dense_index(whole.select(columns).unionByName(cut.select(columns)), [F.col("_o")], "index", ("_o",))
    return places, pools.select("task", "bucket", "row", _example().alias("example_id")), parts
