"""Queries of joins' and aggregations' operators (J*, A*) over rollouts and labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.functions.judge import label_agrees
from tarnfold.operators import groups as g
from tarnfold.operators import reports as r
from tarnfold.operators.curate import small
from tarnfold.plans.base import ROLL, query, rollouts, table
from tarnfold.plans.groups import METRICS, metrics

def good() -> Column:
    return F.col("quality") == 1


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


L = "WITH l AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars FROM labels l JOIN documents d USING (doc_id))\n"


@query("a1_accuracy", ROLL + "SELECT count(*) AS n, round(avg(answer_correctness), 9) AS accuracy FROM roll")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).agg(F.count("*").alias("n"), F.round(r.accuracy(F.col("answer_correctness")), 9).alias("accuracy"))


@query("a2_breakdown", L + "SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_correct, round(avg(quality), 9) AS accuracy FROM l GROUP BY 1")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return r.breakdown(labelled(spark, d), good(), "lang").withColumn("accuracy", F.round("accuracy", 9))


@query("a3_metric_block", L + "SELECT source, count(*) AS n, round(avg(quality), 9) AS accuracy, round(avg(toxic), 9) AS toxic_rate, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END), 9) AS long_rate FROM l GROUP BY 1")
def a3(spark: SparkSession, d: str) -> DataFrame:
    t = labelled(spark, d).groupBy("source")
    return t.agg(F.count("*").alias("n"), F.round(r.accuracy(good()), 9).alias("accuracy"), F.round(r.accuracy(F.col("toxic")), 9).alias("toxic_rate"), F.round(r.accuracy(F.col("n_chars") > 1000), 9).alias("long_rate"))


@query("a4_grouping_sets", L + """SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source, 'all') AS bucket, count(*) AS n, round(avg(quality), 9) AS accuracy
FROM l GROUP BY GROUPING SETS ((lang), (source), ())""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return r.grouping_sets(labelled(spark, d), good(), ["lang", "source"]).withColumn("accuracy", F.round("accuracy", 9))


@query("a5_distribution", ROLL + "SELECT error_type, count(*) AS n FROM roll GROUP BY 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return r.distribution(rollouts(spark, d), "error_type")


@query("a6_exploded_tags", ROLL + """, t AS (SELECT unnest(list_filter([CASE WHEN answer_correctness = 0 AND suitability >= 3 THEN 'wrong_high_prior' END, CASE WHEN answer_correctness = 1 AND suitability <= 1 THEN 'correct_low_prior' END,
  CASE WHEN step_validity = 0 THEN 'no_valid_step' END], lambda x: x IS NOT NULL)) AS tag FROM roll) SELECT tag, count(*) AS n FROM t GROUP BY 1""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("answer_correctness")
    tags = F.array_compact(F.array(F.when((c == 0) & (F.col("suitability") >= 3), "wrong_high_prior"), F.when((c == 1) & (F.col("suitability") <= 1), "correct_low_prior"), F.when(F.col("step_validity") == 0, "no_valid_step")))
    return r.distribution(rollouts(spark, d).select(F.explode(tags).alias("tag")), "tag")


@query("a7_composite_distribution", ROLL + "SELECT problem_type || '::' || error_type AS key, count(*) AS n FROM roll GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return r.distribution(rollouts(spark, d).select(F.concat_ws("::", "problem_type", "error_type").alias("key")), "key")


@query("a8_min_max_mean", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


@query("a9_conditional_means", ROLL + """SELECT problem_type, round(avg(CASE WHEN answer_correctness = 1 THEN posterior END), 7) AS correct_mean, round(avg(CASE WHEN answer_correctness = 0 THEN posterior END), 7) AS wrong_mean,
  round(avg(CASE WHEN answer_correctness = 1 THEN posterior END) - avg(CASE WHEN answer_correctness = 0 THEN posterior END), 7) AS gap FROM post GROUP BY 1""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.avg(F.when(F.col("answer_correctness") == v, F.col("posterior"))) for v in (1, 0))
    return g.with_posterior(rollouts(spark, d)).groupBy("problem_type").agg(F.round(a, 7).alias("correct_mean"), F.round(b, 7).alias("wrong_mean"), F.round(a - b, 7).alias("gap"))


@query("a10_threshold_rates", ROLL + """SELECT problem_type, count(*) FILTER (round(posterior, 9) >= 0.5) AS n_at_least, count(*) FILTER (round(posterior, 9) > 0.5) AS n_over, round(count(*) FILTER (round(posterior, 9) >= 0.5) / count(*), 9) AS rate FROM post GROUP BY 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    p = F.round("posterior", 9)
    return g.with_posterior(rollouts(spark, d)).groupBy("problem_type").agg(F.count_if(p >= 0.5).alias("n_at_least"), F.count_if(p > 0.5).alias("n_over"), F.round(F.count_if(p >= 0.5) / F.count("*"), 9).alias("rate"))


RUNS = ROLL + ", acc AS (SELECT problem_type, run, avg(answer_correctness) AS acc FROM roll GROUP BY 1, 2)\n"


def run_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).groupBy("problem_type", "run").agg(F.avg("answer_correctness").alias("acc"))


@query("a11_repeats", RUNS + "SELECT problem_type, count(acc) AS n, round(avg(acc), 9) AS mean, round(CASE WHEN count(acc) = 1 THEN 0 ELSE stddev_pop(acc) END, 9) AS std FROM acc GROUP BY 1")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return r.repeats(run_accuracy(spark, d), ["problem_type"], "acc").withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query("a12_macro_average", L + """SELECT source, round(avg(quality) FILTER (lang = 'en'), 9) AS en, round(avg(quality) FILTER (lang = 'fr'), 9) AS fr, round(avg(quality) FILTER (lang = 'de'), 9) AS de,
  round((avg(quality) FILTER (lang = 'en') + avg(quality) FILTER (lang = 'fr') + avg(quality) FILTER (lang = 'de')) / 3, 9) AS macro FROM l GROUP BY 1""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    names = ["en", "fr", "de"]
    return r.macro(labelled(spark, d), ["source"], "lang", names, "quality").select("source", *[F.round(c, 9).alias(c) for c in (*names, "macro")])


@query("a13_distinct_keys", ROLL + "SELECT problem_type, count(DISTINCT CASE WHEN answer_correctness = 1 THEN group_id END) AS solved, count(DISTINCT group_id) AS groups FROM roll GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).groupBy("problem_type").agg(F.countDistinct(F.when(F.col("answer_correctness") == 1, F.col("group_id"))).alias("solved"), F.countDistinct("group_id").alias("groups"))


@query("a14_distinct_rounded", ROLL + "SELECT group_id, count(DISTINCT round(likelihood, 8)) AS distinct_likelihoods FROM lik GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).groupBy("group_id").agg(F.countDistinct(F.round(g.likelihood(), 8)).alias("distinct_likelihoods"))


@query("a15_majority_vote", ROLL + ", v AS (SELECT group_id, error_type, count(*) AS votes, min(rollout_id) AS f FROM roll GROUP BY 1, 2) SELECT group_id, error_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, f) AS rn FROM v) WHERE rn = 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return r.majority(rollouts(spark, d), ["group_id"], "error_type", "rollout_id")


@query("a16_mode_of_sizes", ROLL + ", s AS (SELECT count(*) AS size FROM roll GROUP BY group_id), c AS (SELECT size, count(*) AS n FROM s GROUP BY 1) SELECT size, n FROM c ORDER BY n DESC, size = 8 DESC, size LIMIT 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return r.mode_preferring(rollouts(spark, d).groupBy("group_id").agg(F.count("*").alias("size")), "size", 8)


@query("a17_a18_group_any_mass", ROLL + "SELECT group_id, bool_or(answer_correctness = 1) AS any_correct, bool_and(answer_correctness = 1) AS all_correct, round(sum(CASE WHEN answer_correctness = 1 THEN posterior ELSE 0 END), 8) AS mass FROM post GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("answer_correctness") == 1
    return g.with_posterior(rollouts(spark, d)).groupBy("group_id").agg(F.some(c).alias("any_correct"), F.every(c).alias("all_correct"), F.round(F.sum(F.when(c, F.col("posterior")).otherwise(0.0)), 8).alias("mass"))


@query("a19_two_level", METRICS + """SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, round(avg(any_correct::INT), 6) AS any_correct_rate, round(avg(top_correct::INT), 6) AS top_correct_rate, round(avg(mass_on_correct), 5) AS mean_mass,
  round(avg(entropy), 4) AS mean_entropy, round(avg(top_gap), 5) AS mean_gap, count(*) FILTER (any_correct AND NOT top_correct) AS wrong_top FROM gm""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    return m.agg(F.count("*").alias("n_groups"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.avg(F.col("any_correct").cast("int")), 6).alias("any_correct_rate"), F.round(F.avg(F.col("top_correct").cast("int")), 6).alias("top_correct_rate"), F.round(F.avg("mass_on_correct"), 5).alias("mean_mass"), F.round(F.avg("entropy"), 4).alias("mean_entropy"), F.round(F.avg("top_gap"), 5).alias("mean_gap"), F.count_if("wrong_top").alias("wrong_top"))


@query("a20_teacher_vs_learned", ROLL + """, b AS (SELECT group_id, CASE WHEN answer_correctness = 1 THEN likelihood ELSE 0 END AS tc, likelihood AS t, 0.8 * answer_correctness + 0.2 * (step_validity + proof_completeness + strategy_compliance + consistency) / 16.0 AS l, answer_correctness AS c FROM lik),
m AS (SELECT group_id, sum(tc) / nullif(sum(t), 0) AS tm, sum(l * c) / nullif(sum(l), 0) AS lm FROM b GROUP BY 1) SELECT count(*) AS n, round(avg(tm), 6) AS teacher_mass, round(avg(lm), 6) AS learned_mass, round(avg(lm) - avg(tm), 6) AS delta FROM m""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumns({"t": g.likelihood(), "l": g.simple_likelihood()})
    mass = lambda c: F.try_divide(F.sum(F.when(F.col("answer_correctness") == 1, F.col(c)).otherwise(0.0)), F.nullif(F.sum(c), F.lit(0.0)))
    m = t.groupBy("group_id").agg(mass("t").alias("tm"), mass("l").alias("lm"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("tm"), 6).alias("teacher_mass"), F.round(F.avg("lm"), 6).alias("learned_mass"), F.round(F.avg("lm") - F.avg("tm"), 6).alias("delta"))


@query("a21_rates_and_mae", ROLL + """, p AS (SELECT *, group_id % 11 <> 0 AS parsed, group_id % 11 <> 0 AND group_id % 13 <> 0 AS valid, CASE WHEN group_id % 5 = 0 THEN 'arithmetic_error' ELSE error_type END AS judged FROM roll)
SELECT run, round(avg(parsed::INT), 9) AS parse_rate, round(avg(valid::INT), 9) AS valid_rate, round(avg(CASE WHEN valid THEN abs(step_validity - proof_completeness) END), 9) AS mae, round(avg(CASE WHEN valid THEN (step_validity = proof_completeness)::INT END), 9) AS exact_rate,
  round(avg((valid AND (answer_correctness = 1) = (judged LIKE '%correct%'))::INT), 9) AS consistency_rate FROM p GROUP BY 1""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.col("group_id") % 11 != 0
    valid = parsed & (F.col("group_id") % 13 != 0)
    diff = F.abs(F.col("step_validity") - F.col("proof_completeness"))
    agrees = valid & label_agrees(F.col("answer_correctness"), F.when(F.col("group_id") % 5 == 0, "arithmetic_error").otherwise(F.col("error_type")))
    return rollouts(spark, d).groupBy("run").agg(F.round(r.accuracy(parsed), 9).alias("parse_rate"), F.round(r.accuracy(valid), 9).alias("valid_rate"), F.round(F.avg(F.when(valid, diff)), 9).alias("mae"), F.round(F.avg(F.when(valid, (diff == 0).cast("int"))), 9).alias("exact_rate"), F.round(r.accuracy(agrees), 9).alias("consistency_rate"))


@query("a22_lambda_sweep", ROLL + """, s AS (SELECT group_id, rollout_id, answer_correctness, likelihood, lam, pow(prior, lam) AS q FROM lik, (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0)) v(lam)),
p AS (SELECT *, CASE WHEN sum(q * likelihood) OVER w > 0 THEN q * likelihood / sum(q * likelihood) OVER w ELSE 1.0 / count(*) OVER w END AS posterior FROM s WINDOW w AS (PARTITION BY lam, group_id)),
m AS (SELECT lam, group_id, sum(posterior * answer_correctness) AS mass, CASE WHEN count(*) > 1 THEN -sum(CASE WHEN posterior > 0 THEN posterior * ln(posterior) ELSE 0 END) / ln(count(*)) ELSE 0 END AS ent FROM p GROUP BY 1, 2)
SELECT lam, count(*) AS n_groups, round(avg(mass), 7) AS mass_on_correct, round(avg(ent), 7) AS entropy FROM m GROUP BY 1""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    base = g.with_posterior(rollouts(spark, d)).select("group_id", "rollout_id", "answer_correctness", "likelihood", "prior")
    t = r.sweep(base, "lam", [0.0, 0.5, 1.0, 2.0])
    t = t.withColumn("p", g.posterior(F.col("prior"), F.col("likelihood"), g.group("group_id", "lam"), F.col("lam"))[0])
    m = t.groupBy("group_id", "lam").agg(F.sum(F.col("p") * F.col("answer_correctness")).alias("mass"), g.entropy(F.col("p"), "scaled").alias("ent"))
    return m.groupBy("lam").agg(F.count("*").alias("n_groups"), F.round(F.avg("mass"), 7).alias("mass_on_correct"), F.round(F.avg("ent"), 7).alias("entropy"))


SWEPT = ROLL + """, s AS (SELECT group_id, rollout_id, answer_correctness, likelihood, lam, pow(prior, lam) AS q FROM lik, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0), (2.0)) v(lam)),
p AS (SELECT *, round(CASE WHEN sum(q * likelihood) OVER w > 0 THEN q * likelihood / sum(q * likelihood) OVER w ELSE 1.0 / count(*) OVER w END, 9) AS posterior FROM s WINDOW w AS (PARTITION BY lam, group_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY lam, group_id ORDER BY posterior DESC, rollout_id) AS rk FROM p),
m AS (SELECT lam, group_id, max(CASE WHEN rk = 1 THEN answer_correctness END) AS top, max(answer_correctness) AS best, sum(posterior * answer_correctness) AS mass FROM k GROUP BY 1, 2),
l AS (SELECT lam, round(avg(CASE WHEN best = 1 THEN top END), 6) AS top1_when_correct_exists, round(avg(top), 6) AS top1_all, count(*) FILTER (best = 1 AND top = 0) AS wrong_top_count, round(avg(mass), 6) AS mass_on_correct_mean,
  round(avg((group_id % 11 <> 0)::INT), 6) AS prior_parse_rate, round(avg((group_id % 13 <> 0)::INT), 6) AS evidence_parse_rate FROM m GROUP BY 1)
"""


@query("a23_best_candidate", SWEPT + "SELECT * FROM l ORDER BY top1_when_correct_exists DESC, top1_all DESC, wrong_top_count, mass_on_correct_mean DESC, prior_parse_rate DESC, evidence_parse_rate DESC, lam LIMIT 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    """The best parameter value of a sweep, by seven keys."""
    base = g.with_posterior(rollouts(spark, d)).select("group_id", "rollout_id", "answer_correctness", "likelihood", "prior")
    t = r.sweep(base, "lam", [0.0, 0.25, 0.5, 1.0, 2.0])
    t = t.withColumn("p", F.round(g.posterior(F.col("prior"), F.col("likelihood"), g.group("group_id", "lam"), F.col("lam"))[0], 9))
    m = t.groupBy("lam", "group_id").agg(F.max_by("answer_correctness", F.struct("p", -F.col("rollout_id"))).alias("top"), F.max("answer_correctness").alias("best"), F.sum(F.col("p") * F.col("answer_correctness")).alias("mass"))
    rate = lambda c: F.round(F.avg(c), 6)
    metrics = m.groupBy("lam").agg(
        rate(F.when(F.col("best") == 1, F.col("top"))).alias("top1_when_correct_exists"),
        rate("top").alias("top1_all"),
        F.count_if((F.col("best") == 1) & (F.col("top") == 0)).alias("wrong_top_count"),
        rate("mass").alias("mass_on_correct_mean"),
        rate((F.col("group_id") % 11 != 0).cast("int")).alias("prior_parse_rate"),
        rate((F.col("group_id") % 13 != 0).cast("int")).alias("evidence_parse_rate"),
    )
    return r.best(metrics, [F.desc("top1_when_correct_exists"), F.desc("top1_all"), F.asc("wrong_top_count"), F.desc("mass_on_correct_mean"), F.desc("prior_parse_rate"), F.desc("evidence_parse_rate"), F.asc("lam")])


@query("a24_gates", RUNS + """, b AS (SELECT problem_type, avg(acc) FILTER (run = 0) AS base, avg(acc) FILTER (run = 1) AS cand FROM acc GROUP BY 1)
SELECT problem_type, cand >= 0.2 AS min_accuracy, cand >= base - 0.01 AS no_regression, cand >= 0.2 AND cand >= base - 0.01 AS passed FROM b""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    wide = run_accuracy(spark, d).groupBy("problem_type").pivot("run", [0, 1]).agg(F.avg("acc")).toDF("problem_type", "base", "cand")
    return r.gates(wide, {"min_accuracy": F.col("cand") >= 0.2, "no_regression": F.col("cand") >= F.col("base") - 0.01}).drop("base", "cand")


@query("a25_a26_deltas", RUNS + "SELECT problem_type, round(avg(acc) FILTER (run = 0), 9) AS r0, round(avg(acc) FILTER (run = 1), 9) AS r1, round(avg(acc) FILTER (run = 0) - avg(acc) FILTER (run = 1), 9) AS delta FROM acc GROUP BY 1")
def a25(spark: SparkSession, d: str) -> DataFrame:
    t = r.delta(run_accuracy(spark, d).withColumn("run", F.concat(F.lit("r"), "run")), ["problem_type"], "run", "r0", "r1", "acc")
    return t.select("problem_type", *[F.round(c, 9).alias(c) for c in ("r0", "r1", "delta")])


@query("a25_biggest_effect", RUNS + ", e AS (SELECT problem_type, avg(acc) FILTER (run = 0) - avg(acc) FILTER (run = 1) AS delta FROM acc GROUP BY 1) SELECT problem_type, round(delta, 9) AS delta FROM e ORDER BY abs(round(delta, 9)) DESC, problem_type LIMIT 1")
def a25b(spark: SparkSession, d: str) -> DataFrame:
    return r.best(a25(spark, d).select("problem_type", "delta"), [F.desc(F.abs("delta")), F.asc("problem_type")])


@query("a27_alias_provenance", """SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'priority' WHEN o_orderstatus = 'F' THEN 'status' WHEN o_totalprice > 100000 THEN 'price' ELSE 'missing' END AS supplied_by, count(*) AS n FROM orders GROUP BY 1""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    by = F.when(F.col("o_orderpriority").startswith("1"), "priority").when(F.col("o_orderstatus") == "F", "status").when(F.col("o_totalprice") > 100000, "price").otherwise("missing")
    return r.distribution(table(spark, d, "orders").select(by.alias("supplied_by")), "supplied_by")


@query("a28_nested_failures", ROLL + "SELECT problem_type, run, error_type, count(*) AS n FROM roll WHERE error_type NOT LIKE 'correct%' GROUP BY 1, 2, 3")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return r.distribution(rollouts(spark, d).where(~F.col("error_type").startswith("correct")), "problem_type", "run", "error_type")


# Joins


@query("j2_first_match_lookup", "WITH m AS (SELECT lang, arg_min(source, doc_id) AS first_source FROM documents GROUP BY 1) SELECT doc_id, lang, first_source FROM documents LEFT JOIN m USING (lang)")
def j2(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang", "source")
    return t.select("doc_id", "lang").join(t.groupBy("lang").agg(F.min_by("source", "doc_id").alias("first_source")), "lang", "left")


@query("j3_exists_in_comparison", ROLL + ", s AS (SELECT group_id, list(answer_correctness) AS a FROM roll WHERE run = 1 GROUP BY 1) SELECT r.group_id, rollout_id, coalesce(len(list_filter(a, lambda x: x = 1)) > 0, false) AS solved_elsewhere FROM roll r LEFT JOIN s USING (group_id) WHERE r.run = 0")
def j3(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d)
    s = t.where("run = 1").groupBy("group_id").agg(F.some(F.col("answer_correctness") == 1).alias("solved"))
    return t.where("run = 0").join(s, "group_id", "left").select("group_id", "rollout_id", F.coalesce("solved", F.lit(False)).alias("solved_elsewhere"))


@query("j4_multiway_runs", ROLL + "SELECT group_id, count(*) AS n FROM roll GROUP BY 1 HAVING count(DISTINCT run) = 3")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("run").alias("k")).where("k = 3").drop("k")


J5 = ROLL + ", p AS (SELECT group_id, run, answer_correctness AS c, step_validity AS s, row_number() OVER (PARTITION BY group_id, run ORDER BY rollout_id) AS i FROM roll)\n"


@query("j5_by_position", J5 + "SELECT a.group_id, a.i, a.c AS c0, b.c AS c1 FROM p a JOIN p b ON a.group_id = b.group_id AND a.i = b.i WHERE a.run = 0 AND b.run = 1")
def j5(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("group_id", "run").orderBy("rollout_id")).cast("long"))
    side = lambda k: t.where(F.col("run") == k).select("group_id", "i", F.col("answer_correctness").alias(f"c{k}"))
    return side(0).join(side(1), ["group_id", "i"])


@query("j6_last_row_lookup", "WITH m AS (SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY 1) SELECT event_id, last_value FROM events LEFT JOIN m USING (user_id)")
def j6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id").join(e.groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value")), "user_id", "left").drop("user_id")


@query("j7_array_probe", ROLL + ", a AS (SELECT group_id, list({'id': rollout_id, 's': suitability}) AS items FROM roll WHERE rollout_id % 2 = 0 GROUP BY 1) SELECT r.group_id, r.rollout_id, list_filter(items, lambda x: x.id = r.rollout_id)[1].s AS judged FROM roll r LEFT JOIN a USING (group_id)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """The judge's item of a rollout, out of its group's array: no shuffle beyond the group's own."""
    t = rollouts(spark, d)
    items = F.collect_list(F.when(F.col("rollout_id") % 2 == 0, F.struct(F.col("rollout_id").alias("id"), F.col("suitability").alias("s")))).over(g.group("group_id"))
    return t.withColumn("items", items).select("group_id", "rollout_id", F.get(F.filter("items", lambda x: x["id"] == F.col("rollout_id")), 0)["s"].alias("judged"))


@query("j8_pairwise_preferences", ROLL + "SELECT a.group_id, a.rollout_id AS better, b.rollout_id AS worse FROM roll a JOIN roll b ON a.group_id = b.group_id AND a.suitability > b.suitability")
def j8(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).select("group_id", "rollout_id", "suitability")
    b = t.select(F.col("group_id").alias("g2"), F.col("rollout_id").alias("worse"), F.col("suitability").alias("s2"))
    return t.join(b, (F.col("group_id") == F.col("g2")) & (F.col("suitability") > F.col("s2"))).select("group_id", F.col("rollout_id").alias("better"), "worse")


@query("j9_group_similarity_sums", """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM n)
SELECT a.vec_id, round(sum(list_dot_product(a.u, b.u)), 6) AS sum_cos, count(*) AS n FROM u a JOIN u b ON a.label = b.label GROUP BY 1""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    sizes = small(t.groupBy("label").agg(F.count("*").alias("n")))
    return g.diversity(t, ("label",), "embedding", eps=0.0).join(sizes, "label").select("vec_id", F.round(1 / F.col("diversity_weight"), 6).alias("sum_cos"), "n")


@query("j11_score_compare", ROLL + "SELECT group_id, round(avg(abs(step_validity - consistency)), 9) AS mae, bool_and(step_validity = consistency) AS exact FROM roll GROUP BY 1")
def j11(spark: SparkSession, d: str) -> DataFrame:
    off = F.abs(F.col("step_validity") - F.col("consistency"))
    return rollouts(spark, d).groupBy("group_id").agg(F.round(F.avg(off), 9).alias("mae"), F.every(off == 0).alias("exact"))


@query("j12_precedence_coalesce", """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN s_acctbal > 0 THEN s_name END, n_name, r_name, 'none') AS label
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    c, s, n, rg = (table(spark, d, t) for t in ("customer", "supplier", "nation", "region"))
    t = c.join(s, c.c_custkey == s.s_suppkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(rg, n.n_regionkey == rg.r_regionkey, "left")
    return t.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 5000, F.col("c_name")), F.when(F.col("s_acctbal") > 0, F.col("s_name")), "n_name", "r_name", F.lit("none")).alias("label"))


@query("j13_job_matrix", "SELECT n_name AS spec, r_name AS dataset, CAST(k AS INT) AS repeat FROM nation, region, range(3) t(k) WHERE NOT (n_regionkey = r_regionkey AND k = 2)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Experiment specs x datasets x repeats: three tables of settings, not of data."""
    n, rg = table(spark, d, "nation"), table(spark, d, "region")
    t = n.crossJoin(rg).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return t.where(~((F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("repeat") == 2))).select(F.col("n_name").alias("spec"), F.col("r_name").alias("dataset"), "repeat")


@query("j14_full_outer", ROLL + ", a AS (SELECT error_type, count(*) AS n FROM roll WHERE run = 0 AND step_validity > 3 GROUP BY 1), b AS (SELECT error_type, count(*) AS n FROM roll WHERE run = 1 AND step_validity < 2 GROUP BY 1) SELECT coalesce(a.error_type, b.error_type) AS error_type, coalesce(a.n, 0) AS n0, coalesce(b.n, 0) AS n1 FROM a FULL JOIN b ON a.error_type = b.error_type")
def j14(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d)
    a = t.where("run = 0 and step_validity > 3").groupBy("error_type").agg(F.count("*").alias("n0"))
    b = t.where("run = 1 and step_validity < 2").groupBy("error_type").agg(F.count("*").alias("n1"))
    return a.join(b, "error_type", "full_outer").select("error_type", F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"))
