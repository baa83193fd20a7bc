"""Queries of the per-group operators (g.group("group_id")*) over the rollout view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators import groups as g
from tarnfold.operators import rewards as rw
from tarnfold.plans.base import ROLL, query, rollouts, table

KEY = ("group_id",)


def _post(spark: SparkSession, d: str) -> DataFrame:
    return g.with_posterior(rollouts(spark, d))


@query("w1_rollout_index", ROLL + "SELECT group_id, rollout_id, answer_correctness FROM roll")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).select("group_id", "rollout_id", "answer_correctness")


@query("w2_mixed_order", """WITH t AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'r' || (o_orderkey % 10) ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS rid FROM orders)
SELECT id, k, rid, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN rid IS NULL THEN 2 WHEN try_cast(rid AS DOUBLE) IS NULL THEN 1 ELSE 0 END, try_cast(rid AS DOUBLE), rid, id) AS rn FROM t""")
def w2(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rid = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("r"), (F.col("o_orderkey") % 10).cast("string"))).otherwise((F.col("o_orderkey") % 100).cast("string"))
    t = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), rid.alias("rid"))
    return t.withColumn("rn", F.row_number().over(g.group("k").orderBy(*g.mixed_order(F.col("rid")), "id")).cast("long"))


@query("w3_softmax_prior", ROLL + "SELECT group_id, rollout_id, round(prior, 9) AS prior FROM lik")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).select("group_id", "rollout_id", F.round(g.softmax(F.col("suitability").cast("double"), g.group("group_id")), 9).alias("prior"))


@query("w3_softmax_temperature", ROLL + """, e AS (SELECT *, exp((suitability - max(suitability) OVER (PARTITION BY group_id)) / 0.5) AS x FROM roll)
SELECT group_id, rollout_id, round(x / sum(x) OVER (PARTITION BY group_id), 9) AS prior FROM e""")
def w3t(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).select("group_id", "rollout_id", F.round(g.softmax(F.col("suitability").cast("double"), g.group("group_id"), 0.5), 9).alias("prior"))


@query("w4_likelihood_variants", ROLL + """SELECT group_id, rollout_id, round(likelihood, 9) AS full_reward,
  round(0.70 * answer_correctness + 0.10 * step_validity / 4.0 + 0.10 * proof_completeness / 4.0 + 0.05 * strategy_compliance / 4.0 + 0.05 * consistency / 4.0, 9) AS first_reward,
  round(0.40 * answer_correctness + 0.25 * step_validity / 4.0 + 0.20 * proof_completeness / 4.0 + 0.10 * strategy_compliance / 4.0 + 0.05 * consistency / 4.0, 9) AS trajectory,
  round(0.8 * answer_correctness + 0.2 * (step_validity + proof_completeness + strategy_compliance + consistency) / 4.0 / 4.0, 9) AS simple FROM lik""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    cols = {"full_reward": g.likelihood(), "first_reward": g.likelihood(g.WEIGHTS["first"]), "trajectory": g.likelihood(g.WEIGHTS["trajectory"], normalise=True), "simple": g.simple_likelihood()}
    return rollouts(spark, d).select("group_id", "rollout_id", *[F.round(c, 9).alias(k) for k, c in cols.items()])


@query("w5_posterior", ROLL + "SELECT group_id, rollout_id, round(prior, 9) AS prior, round(likelihood, 9) AS likelihood, round(posterior, 9) AS posterior, fallback FROM post")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return _post(spark, d).select("group_id", "rollout_id", *[F.round(c, 9).alias(c) for c in ("prior", "likelihood", "posterior")], "fallback")


@query("w6_tempered_posterior", ROLL + """, t AS (SELECT *, pow(prior, 0.5) / sum(pow(prior, 0.5)) OVER (PARTITION BY group_id) AS tp FROM lik)
SELECT group_id, rollout_id, round(tp, 9) AS tempered, round(CASE WHEN sum(tp * likelihood) OVER w > 0 THEN tp * likelihood / sum(tp * likelihood) OVER w ELSE 1.0 / count(*) OVER w END, 9) AS posterior FROM t WINDOW w AS (PARTITION BY group_id)""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    t = _post(spark, d).withColumn("tempered", g.tempered(F.col("prior"), g.group("group_id"), 0.5))
    return t.select("group_id", "rollout_id", F.round("tempered", 9).alias("tempered"), F.round(g.normalise(F.col("tempered") * F.col("likelihood"), g.group("group_id"))[0], 9).alias("posterior"))


@query("w7_normalise_any_bad", ROLL + """, t AS (SELECT *, CASE WHEN step_validity = 4 AND consistency = 4 THEN -1.0 ELSE proof_completeness * 1.0 END AS x FROM roll)
SELECT group_id, rollout_id, round(CASE WHEN bool_or(x < 0) OVER w OR sum(x) OVER w <= 0 THEN 1.0 / count(*) OVER w ELSE x / sum(x) OVER w END, 9) AS p, bool_or(x < 0) OVER w OR sum(x) OVER w <= 0 AS fallback FROM t WINDOW w AS (PARTITION BY group_id)""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("x", F.when((F.col("step_validity") == 4) & (F.col("consistency") == 4), -1.0).otherwise(F.col("proof_completeness").cast("double")))
    p, bad = g.normalise(F.col("x"), g.group("group_id"))
    return t.select("group_id", "rollout_id", F.round(p, 9).alias("p"), bad.alias("fallback"))


@query("w8_argmax_first", ROLL + """SELECT group_id, rollout_id FROM (SELECT group_id, rollout_id, row_number() OVER (PARTITION BY group_id ORDER BY round(likelihood, 9) DESC, rollout_id) AS rn FROM lik) WHERE rn = 1""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("v", F.round(g.likelihood(), 9))
    return t.groupBy("group_id").agg(g.top_index("v").cast("long").alias("rollout_id"))


_TOP = "max(CASE WHEN {0}_rn = 1 THEN answer_correctness END)"


@query("w9_top1_accuracy", ROLL + """, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(posterior, 9) DESC, rollout_id) AS p_rn, row_number() OVER (PARTITION BY group_id ORDER BY round(likelihood, 9) DESC, rollout_id) AS l_rn,
  row_number() OVER (PARTITION BY group_id ORDER BY round(prior, 9) DESC, rollout_id) AS q_rn, row_number() OVER (PARTITION BY group_id ORDER BY answer_correctness DESC, rollout_id) AS o_rn FROM post),
v AS (SELECT group_id, consistency, count(*) AS n, min(rollout_id) AS f, arg_min(answer_correctness, rollout_id) AS c FROM roll GROUP BY 1, 2), sc AS (SELECT avg(c) AS c FROM (SELECT c, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, f) AS k FROM v) WHERE k = 1),
m AS (SELECT group_id, max(CASE WHEN p_rn = 1 THEN answer_correctness END) AS p, max(CASE WHEN l_rn = 1 THEN answer_correctness END) AS l, max(CASE WHEN q_rn = 1 THEN answer_correctness END) AS q,
  max(CASE WHEN o_rn = 1 THEN answer_correctness END) AS o, max(answer_correctness) AS best, avg(answer_correctness) AS rnd FROM r GROUP BY 1)
SELECT count(*) AS n_groups, round(avg(p), 9) AS by_posterior, round(avg(l), 9) AS by_likelihood, round(avg(q), 9) AS by_prior, round(avg(o), 9) AS by_outcome, round(avg(best), 9) AS oracle, round(avg(rnd), 9) AS random, (SELECT round(c, 9) FROM sc) AS self_consistency FROM m""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    t = _post(spark, d)
    best = lambda c: F.max_by(F.col("answer_correctness"), F.struct(F.round(c, 9), -F.col("rollout_id")))
    m = t.groupBy("group_id").agg(best("posterior").alias("p"), best("likelihood").alias("l"), best("prior").alias("q"), best("answer_correctness").alias("o"), F.max("answer_correctness").alias("best"), F.avg("answer_correctness").alias("rnd"))
    votes = t.groupBy("group_id", "consistency").agg(F.count("*").alias("n"), F.min("rollout_id").alias("f"), F.min_by("answer_correctness", "rollout_id").alias("c"))
    voted = votes.groupBy("group_id").agg(F.max_by("c", F.struct("n", -F.col("f"))).alias("c")).agg(F.round(F.avg("c"), 9).alias("self_consistency"))
    return m.crossJoin(F.broadcast(voted)).agg(F.count("*").alias("n_groups"), F.first("self_consistency").alias("self_consistency"), *[F.round(F.avg(a), 9).alias(b) for a, b in (("p", "by_posterior"), ("l", "by_likelihood"), ("q", "by_prior"), ("o", "by_outcome"), ("best", "oracle"), ("rnd", "random"))])


@query("w10_entropy_variants", ROLL + """SELECT group_id, round(-sum(CASE WHEN posterior > 0 THEN posterior * ln(posterior) ELSE 0 END), 6) + 0.0 AS plain, round(-sum(posterior * ln(posterior + 1e-12)), 6) + 0.0 AS smoothed,
  round(CASE WHEN count(*) > 1 THEN -sum(CASE WHEN posterior > 0 THEN posterior * ln(posterior) ELSE 0 END) / ln(count(*)) ELSE 0 END, 6) + 0.0 AS scaled,
  round(CASE WHEN count(*) > 1 AND sum(likelihood) > 0 THEN (ln(sum(likelihood)) - sum(CASE WHEN likelihood > 0 THEN likelihood * ln(likelihood) ELSE 0 END) / sum(likelihood)) / ln(count(*)) ELSE 0 END, 6) + 0.0 AS renormalised FROM post GROUP BY group_id""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    p, like = F.col("posterior"), F.col("likelihood")
    return _post(spark, d).groupBy("group_id").agg(*[(F.round(c, 6) + 0.0).alias(k) for k, c in (("plain", g.entropy(p)), ("smoothed", g.entropy(p, "smoothed")), ("scaled", g.entropy(p, "scaled")), ("renormalised", g.entropy(like, "renormalised")))])


@query("w11_top_gap", ROLL + """, a AS (SELECT group_id, list_sort(list(posterior), 'DESC') AS v FROM post GROUP BY 1)
SELECT group_id, round(CASE WHEN len(v) > 1 THEN v[1] - v[2] ELSE v[1] END, 8) AS gap_value, round(CASE WHEN len(v) > 1 THEN v[1] - v[2] ELSE 0 END, 8) AS gap_zero FROM a""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return _post(spark, d).groupBy("group_id").agg(F.round(g.gap(F.col("posterior")), 8).alias("gap_value"), F.round(g.gap(F.col("posterior"), "zero"), 8).alias("gap_zero"))


@query("w12_13_14_advantages", ROLL + """SELECT group_id, rollout_id, round(likelihood - avg(likelihood) OVER w, 7) + 0.0 AS centred,
  round(CASE WHEN count(*) OVER w > 1 THEN (likelihood - avg(likelihood) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE 0 END, 7) + 0.0 AS leave_one_out,
  CASE WHEN stddev_pop(likelihood) OVER w > 1e-7 THEN round((likelihood - avg(likelihood) OVER w) / stddev_pop(likelihood) OVER w, 5) + 0.0 ELSE 0.0 END AS standardised FROM lik WINDOW w AS (PARTITION BY group_id)""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    t, x = rollouts(spark, d).withColumn("likelihood", g.likelihood()), F.col("likelihood")
    flat = F.stddev_pop(x).over(g.group("group_id")) <= 1e-7
    return t.select("group_id", "rollout_id", (F.round(g.centred(x, g.group("group_id")), 7) + 0.0).alias("centred"), (F.round(g.leave_one_out(x, g.group("group_id")), 7) + 0.0).alias("leave_one_out"), F.when(flat, 0.0).otherwise(F.round(g.standardised(x, g.group("group_id")), 5) + 0.0).alias("standardised"))


@query("w15_logp_rewards", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(greatest(least(-l_quantity, 0), -80)), 9) AS sum_exp, round(exp(greatest(least(-l_quantity / greatest(l_linenumber, 1), 0), -80)), 9) AS mean_exp,
  -l_quantity AS sum_raw, round(-l_quantity / greatest(l_linenumber, 1), 9) AS mean_raw FROM lineitem""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    modes = {"sum_exp": "sum_exp", "mean_exp": "mean_exp", "sum_raw": "sum", "mean_raw": "mean"}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(g.logp_reward(-F.col("l_quantity"), F.col("l_linenumber"), m), 9).alias(k) for k, m in modes.items()])


_UNIT = """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM n)"""


@query("w16_diversity_weight", _UNIT + """, x AS (SELECT vec_id, label, unnest(u) AS v, generate_subscripts(u, 1) AS i FROM u), s AS (SELECT label, i, sum(v) AS s FROM x GROUP BY 1, 2)
SELECT vec_id, round(1.0 / (sum(v * s) + 1e-6), 6) AS diversity_weight FROM x JOIN s USING (label, i) GROUP BY vec_id""")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return g.diversity(table(spark, d, "embeddings"), ("label",), "embedding").select("vec_id", F.round("diversity_weight", 6).alias("diversity_weight"))


@query("w17_diversity_reward", _UNIT + """, x AS (SELECT vec_id, label, unnest(u) AS v, generate_subscripts(u, 1) AS i FROM u), s AS (SELECT label, i, sum(v) AS s FROM x GROUP BY 1, 2)
SELECT vec_id, round((vec_id % 2) / (sum(v * s) + 1e-6), 6) AS dra_reward FROM x JOIN s USING (label, i) GROUP BY vec_id""")
def w17(spark: SparkSession, d: str) -> DataFrame:
    t = g.diversity(table(spark, d, "embeddings"), ("label",), "embedding")
    return t.select("vec_id", F.round((F.col("vec_id") % 2) * F.col("diversity_weight"), 6).alias("dra_reward"))


@query("w18_fraction_sets", ROLL + """SELECT group_id, rollout_id, row_number() OVER (PARTITION BY group_id ORDER BY round(likelihood, 9) DESC, rollout_id DESC) <= greatest(1, ceil(count(*) OVER (PARTITION BY group_id) * 0.25)) AS in_top,
  row_number() OVER (PARTITION BY group_id ORDER BY round(likelihood, 9), rollout_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY group_id) * 0.25)) AS in_bottom FROM lik""")
def w18(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("v", F.round(g.likelihood(), 9))
    top, bottom = g.fraction_ranks(F.col("v"), g.group("group_id"), 0.25)
    return t.select("group_id", "rollout_id", top.alias("in_top"), bottom.alias("in_bottom"))


METRICS = ROLL + """, q AS (SELECT *, round(posterior, 9) AS p9 FROM post), gm AS (SELECT group_id, count(*) AS n, bool_or(answer_correctness >= 1) AS any_correct, arg_max(answer_correctness, p9 * 1e6 - rollout_id * 1e-6) >= 1 AS top_correct,
  sum(CASE WHEN answer_correctness >= 1 THEN p9 ELSE 0 END) AS mass_on_correct, CASE WHEN count(*) > 1 THEN -sum(CASE WHEN p9 > 0 THEN p9 * ln(p9) ELSE 0 END) / ln(count(*)) ELSE 0 END AS entropy,
  CASE WHEN count(*) > 1 THEN list_sort(list(p9), 'DESC')[1] - list_sort(list(p9), 'DESC')[2] ELSE 0 END AS top_gap FROM q GROUP BY group_id)
"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return g.metrics(_post(spark, d).withColumn("posterior", F.round("posterior", 9)))


@query("w19_w20_group_metrics", METRICS + "SELECT group_id, n, any_correct, top_correct, round(mass_on_correct, 4) AS mass_on_correct, round(entropy, 4) + 0.0 AS entropy, round(top_gap, 4) AS top_gap, any_correct AND NOT top_correct AS wrong_top FROM gm")
def w19(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("group_id", "n", "any_correct", "top_correct", F.round("mass_on_correct", 4).alias("mass_on_correct"), (F.round("entropy", 4) + 0.0).alias("entropy"), F.round("top_gap", 4).alias("top_gap"), "wrong_top")


@query("w21_near_group_max", ROLL + "SELECT group_id, rollout_id FROM (SELECT *, max(likelihood) OVER (PARTITION BY group_id) AS most FROM lik) WHERE likelihood + 1e-12 >= 0.9 * most")
def w21(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("likelihood", g.likelihood())
    return t.withColumn("mx", F.max("likelihood").over(g.group("group_id"))).where(F.col("likelihood") + 1e-12 >= 0.9 * F.col("mx")).select("group_id", "rollout_id")


@query("w23_align_gold", """WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
gold AS (SELECT conv_id, list(role ORDER BY turn) FILTER (turn < 2) AS g FROM conversations GROUP BY 1)
SELECT conv_id, turn, gold.g[CAST(i // greatest(1, CAST(ceil(n / len(gold.g)) AS BIGINT)) AS BIGINT) + 1] AS gold_role FROM t JOIN gold USING (conv_id)""")
def w23(spark: SparkSession, d: str) -> DataFrame:
    """Golds repeated over positions: completion i of n belongs to gold i // ceil(n / golds)."""
    c = table(spark, d, "conversations")
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    gold = F.transform(F.filter("m", lambda x: x["turn"] < 2), lambda x: x["role"])
    flat = packed.select("conv_id", gold.alias("g"), F.size("m").alias("n"), F.posexplode("m").alias("i", "x"))
    each = F.greatest(F.lit(1), F.ceil(F.col("n") / F.size("g"))).cast("int")
    return flat.select("conv_id", F.col("x.turn").alias("turn"), F.get("g", F.floor(F.col("i") / each).cast("int")).alias("gold_role"))


# The same rewards by registered group functions.


@query("w5_by_callback", ROLL + "SELECT group_id, rollout_id, round(posterior, 9) AS posterior, fallback FROM post")
def w5_callback(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("likelihood", g.likelihood())
    return rw.apply(t, "posterior", KEY, "rollout_id").withColumn("posterior", F.round("posterior", 9))


@query("w6_by_callback", ROLL + """, t AS (SELECT *, pow(prior, 0.5) / sum(pow(prior, 0.5)) OVER (PARTITION BY group_id) AS tp FROM lik)
SELECT group_id, rollout_id, round(CASE WHEN sum(tp * likelihood) OVER w > 0 THEN tp * likelihood / sum(tp * likelihood) OVER w ELSE 1.0 / count(*) OVER w END, 9) AS posterior FROM t WINDOW w AS (PARTITION BY group_id)""")
def w6_callback(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("likelihood", g.likelihood())
    return rw.apply(t, "tempered_posterior", KEY, "rollout_id", power=0.5).select("group_id", "rollout_id", F.round("posterior", 9).alias("posterior"))


@query("w10_by_callback", ROLL + """SELECT group_id, rollout_id, round(CASE WHEN count(*) OVER w > 1 THEN -sum(CASE WHEN posterior > 0 THEN posterior * ln(posterior) ELSE 0 END) OVER w / ln(count(*) OVER w) ELSE 0 END, 6) + 0.0 AS entropy FROM post WINDOW w AS (PARTITION BY group_id)""")
def w10_callback(spark: SparkSession, d: str) -> DataFrame:
    return rw.apply(_post(spark, d), "entropy", KEY, "rollout_id").withColumn("entropy", F.round("entropy", 6) + 0.0)


@query("w13_by_callback", ROLL + """SELECT group_id, rollout_id, round(CASE WHEN count(*) OVER w > 1 THEN (likelihood - avg(likelihood) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE 0 END, 7) + 0.0 AS advantage FROM lik WINDOW w AS (PARTITION BY group_id)""")
def w13_callback(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d).withColumn("reward", g.likelihood())
    return rw.apply(t, "leave_one_out", KEY, "rollout_id").withColumn("advantage", F.round("advantage", 7) + 0.0)


@query("w16_incomplete_groups", _UNIT + """, b AS (SELECT *, vec_id // 8 AS batch FROM u), c AS (SELECT batch, count(*) AS rows FROM b GROUP BY 1), x AS (SELECT vec_id, batch, unnest(u) AS v, generate_subscripts(u, 1) AS i FROM b), s AS (SELECT batch, i, sum(v) AS s FROM x GROUP BY 1, 2)
SELECT vec_id, CASE WHEN c.rows >= 8 THEN round(1.0 / (sum(v * s) + 1e-6), 5) ELSE 1.0 END AS diversity_weight FROM x JOIN s USING (batch, i) JOIN c USING (batch) GROUP BY vec_id, c.rows""")
def w16_incomplete(spark: SparkSession, d: str) -> DataFrame:
    """Groups of eight by position; of the last, which has fewer, each weighs 1."""
    t = table(spark, d, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 8))
    return g.diversity(t, ("batch",), "embedding", size=8).select("vec_id", F.round("diversity_weight", 5).alias("diversity_weight"))
