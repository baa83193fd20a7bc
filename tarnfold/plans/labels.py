"""Queries of label-data construction (L*, M7-M10) and beliefs (Z*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators import curate as cu
from tarnfold.operators import groups as g
from tarnfold.operators import labels as lb
from tarnfold.plans.base import ROLL, query, rollouts, table
from tarnfold.plans.reports import J5, j5
from tarnfold.sources import files
from tarnfold.streaming import belief as bf
from tarnfold.streaming import log, loop, progress


def post(spark: SparkSession, d: str) -> DataFrame:
    t = g.with_posterior(rollouts(spark, d))
    return t.withColumns({"posterior": F.round("posterior", 9), "likelihood": F.round("likelihood", 9)})


SIG = ROLL + """, p9 AS (SELECT * REPLACE (round(posterior, 9) AS posterior, round(likelihood, 9) AS likelihood) FROM post), t AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY posterior DESC, rollout_id) = 1 AS top FROM p9),
f AS (SELECT *, bool_or(answer_correctness = 1) OVER (PARTITION BY group_id) AND bool_or(top AND answer_correctness = 0) OVER (PARTITION BY group_id) AS missed,
  CASE WHEN error_type IN ('wrong_direction', 'no_meaningful_solution') THEN 'bad' WHEN error_type IN ('arithmetic_error', 'finalization_error') THEN 'good' ELSE 'other' END AS fam FROM t),
s AS (SELECT *, list_filter([CASE WHEN missed AND answer_correctness = 1 THEN 'correct_available_but_not_top' END, CASE WHEN answer_correctness = 0 AND suitability >= 3 AND likelihood <= 0.3 AND fam = 'bad' THEN 'high_prior_wrong_bad_strategy' END,
  CASE WHEN answer_correctness = 0 AND suitability >= 3 AND likelihood <= 0.3 AND fam = 'good' THEN 'high_prior_wrong_good_execution' END, CASE WHEN answer_correctness = 0 AND suitability >= 3 AND likelihood <= 0.3 AND fam = 'other' THEN 'high_prior_wrong_other' END,
  CASE WHEN answer_correctness = 1 AND suitability <= 1 AND likelihood >= 0.8 AND error_type <> 'lucky_correct' THEN 'low_prior_correct' END, CASE WHEN answer_correctness = 1 AND suitability <= 1 AND likelihood >= 0.8 AND error_type = 'lucky_correct' THEN 'low_prior_lucky_correct' END,
  CASE WHEN missed AND top AND answer_correctness = 0 THEN 'wrong_high_posterior_top' END], lambda x: x IS NOT NULL) AS signals FROM f)
"""


@query("l3_signals", SIG + "SELECT group_id, rollout_id, array_to_string(signals, ',') AS signals FROM s")
def l3(spark: SparkSession, d: str) -> DataFrame:
    return lb.with_signals(post(spark, d)).select("group_id", "rollout_id", F.array_join("signals", ",").alias("signals"))


def _case(order: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN list_contains(signals, '{s}') THEN '{b}'" for s, b in order) + " END"


@query("l4_signal_buckets", SIG + f"SELECT group_id, rollout_id, {_case(lb.PAIR_PRIORITY)} AS pair_bucket, {_case(lb.CALIBRATION_PRIORITY)} AS calibration_bucket FROM s WHERE len(signals) > 0")
def l4(spark: SparkSession, d: str) -> DataFrame:
    t = lb.with_signals(post(spark, d)).where(F.size("signals") > 0)
    return t.select("group_id", "rollout_id", lb.bucket(F.col("signals")).alias("pair_bucket"), lb.bucket(F.col("signals"), lb.CALIBRATION_PRIORITY).alias("calibration_bucket"))


@query("m8_l10_correction_pairs", ROLL + """, t AS (SELECT *, CASE WHEN answer_correctness = 1 THEN CASE error_type WHEN 'correct_complete' THEN 4 WHEN 'correct_weak_proof' THEN greatest(3, step_validity) ELSE greatest(2, least(3, step_validity)) END
  ELSE CASE error_type WHEN 'finalization_error' THEN 3 WHEN 'arithmetic_error' THEN 2 ELSE 0 END END AS s2, CASE WHEN answer_correctness = 1 THEN CASE error_type WHEN 'correct_complete' THEN 4 WHEN 'correct_weak_proof' THEN greatest(3, consistency) ELSE greatest(2, least(3, consistency)) END
  ELSE CASE error_type WHEN 'finalization_error' THEN 3 WHEN 'arithmetic_error' THEN 2 WHEN 'wrong_direction' THEN 1 ELSE 0 END END AS c2 FROM roll)
SELECT group_id, rollout_id, '{"step_validity":' || s2 || ',"consistency":' || c2 || '}' AS chosen, '{"step_validity":' || step_validity || ',"consistency":' || consistency || '}' AS rejected FROM t WHERE s2 <> step_validity OR c2 <> consistency""")
def m8(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("fix", lb.correction())
    return lb.pairs(t, F.struct(F.col("fix.step_validity").alias("step_validity"), F.col("fix.consistency").alias("consistency")), F.struct("step_validity", "consistency"), "group_id", "rollout_id")


@query("m9_prior_corrections", SIG + "SELECT group_id, rollout_id, CAST(CASE WHEN list_contains(signals, 'high_prior_wrong_bad_strategy') THEN least(suitability, 1) WHEN list_contains(signals, 'low_prior_correct') THEN greatest(suitability, 3) ELSE suitability END AS INT) AS suitability FROM s")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return lb.with_signals(post(spark, d)).select("group_id", "rollout_id", lb.corrected_prior(F.col("signals")).alias("suitability"))


@query("m10_error_families", ROLL + "SELECT CASE WHEN error_type LIKE '%correct%' THEN 'correct' WHEN error_type IN ('wrong_direction', 'no_meaningful_solution') THEN 'bad_strategy' ELSE 'good_execution' END AS family, count(*) AS n FROM roll GROUP BY 1")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).groupBy(lb.family(F.col("error_type")).alias("family")).agg(F.count("*").alias("n"))


@query("l12_group_examples", ROLL + "SELECT group_id, count(*) AS num_rollouts, string_agg(suitability::VARCHAR, ',' ORDER BY rollout_id) AS targets FROM roll GROUP BY 1 HAVING bool_and(consistency > 0)")
def l12(spark: SparkSession, d: str) -> DataFrame:
    t = lb.group_examples(rollouts(spark, d), F.col("consistency") > 0)
    return t.select("group_id", F.col("num_rollouts").cast("long").alias("num_rollouts"), F.array_join(F.transform("candidates", lambda c: c["suitability"].cast("string")), ",").alias("targets"))


REWARD = "(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def reward() -> Column:
    return F.when(F.col("value") >= 50, 1.0).otherwise(0.0)


BEL = f"SELECT user_id, event_type, 1 + sum({REWARD}) AS alpha, 1 + sum(1 - {REWARD}) AS beta, count(*) AS trials FROM events GROUP BY 1, 2"


@query("z2_beliefs", f"SELECT *, round(alpha / (alpha + beta), 9) AS belief FROM ({BEL})")
def z2(spark: SparkSession, d: str) -> DataFrame:
    return bf.beliefs(table(spark, d, "events"), ["user_id", "event_type"], reward()).withColumn("belief", F.round("belief", 9))


#: How far a record kept to its strategy, and the strategies it used: of `click` and the event's own kind, with weights.
KEPT = "least(1.0, greatest(0.0, (event_id % 7) / 5.0::DOUBLE))"


@query("z3_drift", f"""SELECT user_id, event_type, trials, round(alpha / (alpha + beta) * (1 - drift), 9) AS usability, round(drift, 9) AS drift FROM (SELECT user_id, event_type, count(*) AS trials,
  1 + sum({KEPT} * {REWARD}) AS alpha, 1 + sum({KEPT} * (1 - {REWARD})) AS beta, avg(1 - {KEPT}) AS drift FROM events GROUP BY 1, 2)""")
def z3(spark: SparkSession, d: str) -> DataFrame:
    t = bf.drift(table(spark, d, "events"), ["user_id", "event_type"], F.col("value") >= 50, F.col("event_id") % 7 / 5.0)
    return t.select("user_id", "event_type", "trials", F.round("usability", 9).alias("usability"), F.round("drift", 9).alias("drift"))


@query("z3_credited", f"""WITH e AS (SELECT user_id, {REWARD} AS r, event_type AS strategy, {KEPT} AS w FROM events UNION ALL SELECT user_id, {REWARD}, 'shared', 1 - {KEPT} FROM events)
SELECT user_id, strategy, round(1 + sum(w * r), 9) AS alpha, round(1 + sum(w * (1 - r)), 9) AS beta, round(sum(w), 9) AS trials FROM e GROUP BY 1, 2""")
def z3_used(spark: SparkSession, d: str) -> DataFrame:
    """Each record used its own kind of strategy and a shared one, by weights."""
    w = bf.clamped(F.col("event_id") % 7 / 5.0)
    t = table(spark, d, "events").withColumn("used", F.create_map("event_type", w, F.lit("shared"), 1 - w))
    got = bf.credited(t, ["user_id"], F.col("value") >= 50, "used")
    return got.select("user_id", "strategy", *[F.round(c, 9).alias(c) for c in ("alpha", "beta", "trials")])


@query("z4_prefix_beliefs", f"SELECT event_id, round((1 + coalesce(sum({REWARD}) OVER w, 0)) / (2 + coalesce(count(*) OVER w, 0)), 9) AS belief_before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def z4(spark: SparkSession, d: str) -> DataFrame:
    t = bf.before_each(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], reward())
    return t.select("event_id", F.round("belief_before", 9).alias("belief_before"))


@query("z4_choice", f"SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY alpha / (alpha + beta) DESC, trials DESC, event_type DESC) AS rn FROM ({BEL})) WHERE rn = 1")
def z4c(spark: SparkSession, d: str) -> DataFrame:
    return bf.choose(bf.beliefs(table(spark, d, "events"), ["user_id", "event_type"], reward()), "user_id", "event_type")


@query("z1_z2_streamed_beliefs", f"SELECT event_type, alpha, beta, trials FROM (SELECT event_type, 1 + sum({REWARD}) AS alpha, 1 + sum(1 - {REWARD}) AS beta, count(*) AS trials FROM events GROUP BY 1)")
def z1(spark: SparkSession, d: str) -> DataFrame:
    """Events come in files, are appended to a log in micro-batches by a stream that is started again half-way, and read back from there."""
    inbox, out, at = (files.scratch(spark, name) for name in ("inbox", "log", "checkpoint"))
    for half in halves(spark, d):
        half.repartition(3).write.mode("append").parquet(inbox)
        log.append(log_source(spark, d, inbox), out, at).awaitTermination()
    t = log.read(spark, out, table(spark, d, "events").schema)
    return bf.beliefs(t, ["event_type"], reward()).select("event_type", "alpha", "beta", "trials")


def halves(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events up to a middle time, those without a time among them, and the later ones. The middle is found once: a second approximation may be another, and rows between the two would come twice or never."""
    t = table(spark, d, "events")
    middle = t.agg(F.percentile_approx("ts", 0.5)).first()[0]
    early = F.coalesce(F.col("ts") <= F.lit(middle), F.lit(True))
    return [t.where(early), t.where(~early)]


def log_source(spark: SparkSession, d: str, inbox: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 2).parquet(inbox)


@query("z6_progress", f"SELECT 'beliefs' AS query, count(*) AS input_rows, count(*)::DOUBLE AS observed_rows, sum({REWARD}) AS observed_reward FROM events")
def z6(spark: SparkSession, d: str) -> DataFrame:
    """What the stream of events reports: rows of its micro-batches, and metrics observed in the plan."""
    inbox, out, at = (files.scratch(spark, name) for name in ("inbox", "log", "checkpoint"))
    with progress.Progress(spark) as seen:
        for half in halves(spark, d):
            half.repartition(3).write.mode("append").parquet(inbox)
            stream = log_source(spark, d, inbox).observe("seen", F.count(F.lit(1)).alias("rows"), F.sum(reward()).alias("reward"))
            seen.wait(log.append(stream, out, at, "beliefs"))
        metric = lambda k: F.sum(F.coalesce(F.col("metrics")[k], F.lit(0.0)))
        return seen.table().groupBy("query").agg(F.sum("input_rows").alias("input_rows"), metric("seen.rows").alias("observed_rows"), metric("seen.reward").alias("observed_reward"))


CHOICES = ["direct", "algebra", "cases"]


def offered(spark: SparkSession, d: str) -> DataFrame:
    """Events with the reward that each strategy would bring, in quarters."""
    rewards = [((F.col("event_id") * (k + 2) + k) % 5 / 4.0).alias(c) for k, c in enumerate(CHOICES)]
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.array(*rewards).alias("rewards"))


def _closed_loop_sql() -> str:
    names = range(len(CHOICES))
    belief = lambda k: f"a{k} / (a{k} + b{k})"
    hashed = lambda k: f"sha256('42|' || e.user_id || '|' || e.event_id || '|{CHOICES[k]}')"
    before = lambda k, j: f"({belief(k)} > {belief(j)} OR ({belief(k)} = {belief(j)} AND {hashed(k)} < {hashed(j)}))"
    best = "CASE " + " ".join(f"WHEN {' AND '.join(before(k, j) for j in names if j != k)} THEN {k}" for k in names) + " END"
    take = lambda field: "CASE c " + " ".join(f"WHEN {k} THEN {field(k)}" for k in names) + " END"
    state = ", ".join(f"CASE WHEN c = {k} THEN a{k} + r{k} ELSE a{k} END AS a{k}, CASE WHEN c = {k} THEN b{k} + 1 - r{k} ELSE b{k} END AS b{k}, CASE WHEN c = {k} THEN t{k} + 1 ELSE t{k} END AS t{k}" for k in names)
    start = ", ".join(f"1.0::DOUBLE AS a{k}, 1.0::DOUBLE AS b{k}, 0::BIGINT AS t{k}" for k in names)
    given = ", ".join(f"((event_id * {k + 2} + {k}) % 5) / 4.0::DOUBLE AS r{k}" for k in names)
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {given} FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS chosen, NULL::DOUBLE AS belief, NULL::DOUBLE AS reward, NULL::BIGINT AS trials, {start} FROM events
  UNION ALL SELECT user_id, n, event_id, c, {take(belief)}, {take(lambda k: f"r{k}")}, {take(lambda k: f"t{k}")}, {state}
  FROM (SELECT e.*, {", ".join(f"s.a{k}, s.b{k}, s.t{k}" for k in names)}, {best} AS c FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, event_id, {"CASE chosen " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CHOICES)) + " END"} AS strategy, round(belief, 9) AS belief, reward, trials FROM s WHERE n > 0"""


@query("z4_closed_loop", _closed_loop_sql())
def z4_loop(spark: SparkSession, d: str) -> DataFrame:
    """Every choice made on the beliefs that the user's earlier choices left."""
    t = loop.choose_and_learn(offered(spark, d), CHOICES, "user_id", "event_id", ["ts", "event_id"], "rewards")
    return t.withColumn("belief", F.round("belief", 9))


@query("z5_budget", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5")
def z5(spark: SparkSession, d: str) -> DataFrame:
    """Calls within a budget per key."""
    k = F.row_number().over(g.group("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("k", k).where("k <= 5").select("user_id", "event_id")


@query("z7_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def z7(spark: SparkSession, d: str) -> DataFrame:
    return bf.windowed(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day", "1 hour").withColumn("total", F.round("total", 4))

