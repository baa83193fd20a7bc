"""Queries of coercions, filters, curation, dedup and samplers (P*, T*, U*, J1, J10, S*, K*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.functions import coerce as c
from tarnfold.operators import curate as cu
from tarnfold.operators import sampling as s
from tarnfold.plans.base import ROLL, query, rollouts, table
from tarnfold.sources import files

SEED = 42


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def norm(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("norm", cu.normalised(F.col("text")))


NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\[,!;:]', '', 'g'), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+', ' ', 'g'))"
N = f"WITH n AS (SELECT *, {NORM} AS norm FROM documents)\n"
ORD = "sha256('42|' || doc_id)"


@query("c1_coercions", r"""WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'nan' WHEN 2 THEN ' Yes ' WHEN 3 THEN '' WHEN 4 THEN '2.5' WHEN 5 THEN '3.5' WHEN 6 THEN 'None' ELSE '-7' END AS x FROM events)
SELECT event_id, CASE WHEN isfinite(try_cast(trim(x) AS DOUBLE)) THEN try_cast(trim(x) AS DOUBLE) END AS finite, greatest(0, least(4, CAST(round_even(coalesce(CASE WHEN isfinite(try_cast(trim(x) AS DOUBLE)) THEN try_cast(trim(x) AS DOUBLE) END, 0), 0) AS INT))) AS score,
  greatest(0.0, least(1.0, coalesce(CASE WHEN isfinite(try_cast(trim(x) AS DOUBLE)) THEN try_cast(trim(x) AS DOUBLE) END, 0.0))) AS unit, CASE WHEN lower(trim(x)) IN ('none', 'nan', 'null', '') THEN '' ELSE trim(x) END AS cleaned,
  coalesce(nullif(CASE WHEN lower(trim(x)) IN ('none', 'nan', 'null', '') THEN '' ELSE trim(x) END, ''), event_id::VARCHAR) AS first_present, coalesce(nullif(x, ''), 'unknown') AS bucket,
  lower(trim(x)) IN ('1', 'true', 'yes') OR coalesce(try_cast(trim(x) AS DOUBLE) <> 0, false) AS truthy FROM t""")
def c1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id") % 8
    x = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "nan").when(k == 2, " Yes ").when(k == 3, "").when(k == 4, "2.5").when(k == 5, "3.5").when(k == 6, "None").otherwise("-7")
    t = e.select("event_id", x.alias("x"))
    x = F.col("x")
    return t.select("event_id", c.finite_double(x).alias("finite"), c.score_0_to_4(x).alias("score"), c.unit_interval(x).alias("unit"), c.clean(x).alias("cleaned"), c.first_present(x, F.col("event_id")).alias("first_present"), c.bucket(x).alias("bucket"), c.truthy(x).alias("truthy"))


@query("p1_non_empty", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(source, '')) <> ''")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where((F.trim("text") != "") & (F.trim("source") != "")).select("doc_id")


@query("p2_between", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 5000")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(F.col("n_chars").between(100, 5000)).select("doc_id", "n_chars")


@query("p3_solve_bucket", "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value / 100 >= 0.7 THEN 'easy' WHEN value / 100 >= 0.2 THEN 'medium' WHEN value / 100 >= 0.02 THEN 'hard_but_learnable' ELSE 'too_hard' END AS bucket FROM events")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", c.solve_bucket(F.col("value") / 100).alias("bucket"))


@query("p4_canonical_projection", "SELECT doc_id AS original_idx, trim(coalesce(text, '')) AS problem, coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(lang, ''), 'unknown') AS domain, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS difficulty_bucket FROM documents")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("original_idx"), F.trim(F.coalesce("text", F.lit(""))).alias("problem"), c.bucket(F.col("source")).alias("source"), c.bucket(F.col("lang")).alias("domain"), F.when(F.col("n_chars") < 500, "short").otherwise("long").alias("difficulty_bucket"))


@query("p5_source_exclusion", "SELECT doc_id FROM documents WHERE lower(trim(source)) NOT IN ('src0', 'src7')")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(~F.lower(F.trim("source")).isin("src0", "src7")).select("doc_id")


@query("p6_lambda_equality", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-9")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.abs(c.to_double(F.col("l_discount")) - 0.05) <= 1e-9).select("l_orderkey", "l_linenumber", "l_partkey")


@query("p14_p15_provenance", ROLL + "SELECT group_id, rollout_id, '{\"error_type\":\"' || error_type || '\",\"step_validity\":' || step_validity || CASE WHEN suitability > 0 THEN ',\"suitability\":' || suitability ELSE '' END || '}' AS snapshot FROM roll")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """A nested snapshot; null fields leave no key."""
    snap = F.to_json(F.struct("error_type", "step_validity", F.when(F.col("suitability") > 0, F.col("suitability")).alias("suitability")))
    return rollouts(spark, d).select("group_id", "rollout_id", snap.alias("snapshot"))


@query("p17_alias_allow_list", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' ELSE 'french' END AS language FROM documents WHERE lang IN ('en', 'fr')")
def p17(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.sql("SELECT * FROM VALUES ('en', 'english'), ('fr', 'french') AS t(lang, language)")
    return docs(spark, d).join(F.broadcast(alias), "lang").select("doc_id", "language")


@query("p18_preview", r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) > 120 THEN substr(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), 1, 117) || '...' ELSE regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') END AS preview FROM documents")
def p18(spark: SparkSession, d: str) -> DataFrame:
    line = F.regexp_replace("text", r"\s+", " ")
    return docs(spark, d).select("doc_id", F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 117), F.lit("..."))).otherwise(line).alias("preview"))


@query("j1_decontaminate", N + "SELECT doc_id, norm NOT IN (SELECT norm FROM n WHERE doc_id % 20 = 0) AS kept FROM n WHERE doc_id % 20 <> 0")
def j1(spark: SparkSession, d: str) -> DataFrame:
    t = norm(spark, d).select("doc_id", "norm")
    kept, gone = cu.decontaminate(t.where("doc_id % 20 <> 0"), t.where("doc_id % 20 = 0"), "norm")
    return kept.select("doc_id", F.lit(True).alias("kept")).union(gone.select("doc_id", F.lit(False)))


@query("j1_containment", "SELECT DISTINCT doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def j1c(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole evaluation text."""
    return cu.containing(docs(spark, d), table(spark, d, "benchmark"), "doc_id", "text", "text")


@query("j10_split_overlap", N + "SELECT count(*) AS shared FROM (SELECT norm FROM n WHERE doc_id % 2 = 0 INTERSECT SELECT norm FROM n WHERE doc_id % 2 = 1)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    t = norm(spark, d)
    return t.where("doc_id % 2 = 0").select("norm").intersect(t.where("doc_id % 2 = 1").select("norm")).agg(F.count("*").alias("shared"))


@query("u1_s7_tagged_union", "SELECT 'documents' AS source_file, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def u1(spark: SparkSession, d: str) -> DataFrame:
    a = docs(spark, d).select(F.lit("documents").alias("source_file"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    b = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source_file"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_u8_dedup_first", N + "SELECT min(doc_id) AS doc_id, norm FROM n GROUP BY norm")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return cu.first_by(norm(spark, d).select("doc_id", "norm"), ["norm"], [F.col("doc_id")]).select("doc_id", "norm")


@query("u3_upsert_last", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return cu.last_by(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("event_id")])


@query("u4_merge_tags", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM events GROUP BY 1")
def u4(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("user_id", F.array("event_type").alias("tags"))
    return cu.merge_tags(t, "user_id", "tags").select("user_id", F.array_join("tags", ",").alias("tags"))


@query("u5_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def u5(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(t.where("l_returnflag = 'N'").select("l_partkey"))


@query("u6_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u6(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("u7_missing_artefacts", "SELECT DISTINCT lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u7(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("lang", "source").dropDuplicates()


@query("t1_t2_sorted_counts", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY 1")
def t1(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return cu.dense_index(n, [F.desc("n"), F.asc("source")], "place").withColumn("place", F.col("place") + 1).select("source", "n", "place")


@query("t3_reverse_ranking", "SELECT event_type, count(*) AS trials, round(avg(value), 6) AS belief FROM events GROUP BY 1 ORDER BY belief DESC, trials DESC, event_type DESC LIMIT 3")
def t3(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("trials"), F.round(F.avg("value"), 6).alias("belief"))
    return t.orderBy(F.desc("belief"), F.desc("trials"), F.desc("event_type")).limit(3)


@query("t4_first_k_per_type", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 3")
def t4(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("event_id", "event_type")


@query("t5_seeded_take", f"SELECT doc_id FROM documents ORDER BY {ORD}, doc_id LIMIT 100")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return s.take(docs(spark, d).select("doc_id"), 100, SEED, "doc_id")


SCAN = N + f""", k AS (SELECT doc_id, norm, {ORD} AS o, CASE WHEN norm = '' THEN 'empty' WHEN lower(trim(source)) = 'src3' THEN 'excluded_source' WHEN EXISTS (SELECT 1 FROM n e WHERE e.doc_id % 20 = 0 AND e.norm = n.norm) THEN 'eval_overlap' END AS reason FROM n WHERE doc_id % 20 <> 0),
f AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL, norm ORDER BY o, doc_id) END AS rn FROM k),
g AS (SELECT *, CASE WHEN reason IS NULL AND rn = 1 THEN row_number() OVER (PARTITION BY reason IS NULL AND rn = 1 ORDER BY o, doc_id) END AS place FROM f),
c AS (SELECT CASE WHEN count(*) = 200 THEN max(o) END AS last FROM g WHERE place <= 200),
z AS (SELECT doc_id, CASE WHEN o > last THEN 'unscanned' WHEN reason IS NOT NULL THEN reason WHEN rn > 1 THEN 'duplicate' ELSE 'selected' END AS outcome, o FROM g, c)
"""


def scan(spark: SparkSession, d: str) -> DataFrame:
    t = norm(spark, d).select("doc_id", "norm", "source")
    held = cu.small(t.where("doc_id % 20 = 0").select("norm").distinct().withColumn("_held", F.lit(True)))
    rows = t.where("doc_id % 20 <> 0").join(held, "norm", "left")
    reason = F.when(F.col("norm") == "", "empty").when(F.lower(F.trim("source")) == "src3", "excluded_source").when(F.col("_held"), "eval_overlap")
    return cu.scan_select(rows, reason, "norm", cu.hash_order(SEED, F.col("doc_id")), "doc_id", 200)


@query("t6_scan_dedup_stop", SCAN + "SELECT doc_id, outcome FROM z")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d).select("doc_id", "outcome")


@query("w22_batches", SCAN + "SELECT doc_id, CAST(i AS BIGINT) AS global_idx, CAST(i // 32 AS INT) AS rollout_batch_id, CAST(i % 32 AS INT) AS within_batch_idx FROM (SELECT doc_id, row_number() OVER (ORDER BY o, doc_id) - 1 AS i FROM z WHERE outcome = 'selected')")
def w22(spark: SparkSession, d: str) -> DataFrame:
    t = cu.dense_index(scan(spark, d).where("outcome = 'selected'").select("doc_id", "_o"), [F.col("_o"), F.col("doc_id")], "global_idx")
    a, b = cu.batches(F.col("global_idx"), 32)
    return t.select("doc_id", "global_idx", a.alias("rollout_batch_id"), b.alias("within_batch_idx"))


@query("t7_u9_hash_split", "SELECT doc_id, CASE WHEN ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", cu.hash_split(F.col("doc_id"), 0.1).alias("split"))


@query("t8_sample_per_stratum", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORD}, doc_id) AS rn FROM documents) WHERE rn <= 20")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return s.take_per(docs(spark, d).select("doc_id", "lang"), 20, SEED, ["lang"], "doc_id")


@query("t9_t16_epoch_oversample", """WITH e AS (SELECT item_id, CAST(p AS INT) AS pass, sha256('42|' || p || '|' || item_id) AS h FROM benchmark, range(3) t(p)), n AS (SELECT count(*) AS n FROM benchmark),
k AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY h, item_id) AS rn FROM e) SELECT item_id, pass, row_number() OVER (PARTITION BY item_id ORDER BY pass) - 1 AS instance FROM k, n WHERE pass < 2 OR rn <= n // 2""")
def t9(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id")
    n = b.count()
    return s.oversample(b, 2 * n + n // 2, SEED, "item_id", rows=n)


SHARES = "WITH b AS (SELECT lang, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY 1), x AS (SELECT lang, share, round(share * 97, 9) AS e FROM b), q AS (SELECT lang, floor(e) + (row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, e DESC, lang DESC) <= 97 - sum(floor(e)) OVER ())::INT AS quota FROM x)\n"


def quotas(spark: SparkSession, d: str, total: int) -> DataFrame:
    n = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return s.largest_remainder(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))), total, "lang", "share")


@query("t10_largest_remainder", SHARES + "SELECT lang, CAST(quota AS BIGINT) AS quota FROM q")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return quotas(spark, d, 97).select("lang", "quota")


@query("t11_stratified_backfill", SHARES + f""", k AS (SELECT doc_id, d.lang, {ORD} AS h, row_number() OVER (PARTITION BY d.lang ORDER BY {ORD}, doc_id) AS rn, least(coalesce(quota, 0), 12) AS quota FROM documents d LEFT JOIN q USING (lang)),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY h, doc_id) AS p FROM k WHERE rn > quota), lack AS (SELECT 97 - count(*) AS lack FROM k WHERE rn <= quota)
SELECT doc_id, lang, 'quota' AS via FROM k WHERE rn <= quota UNION ALL SELECT doc_id, lang, 'backfill' FROM r, lack WHERE p <= lack""")
def t11(spark: SparkSession, d: str) -> DataFrame:
    q = quotas(spark, d, 97).withColumn("quota", F.least("quota", F.lit(12)))
    return s.stratified(docs(spark, d).select("doc_id", "lang"), q, "lang", 97, SEED, "doc_id").select("doc_id", "lang", "via")


@query("t12_rebalance", "WITH c AS (SELECT count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b FROM labels), t AS (SELECT a, b, least(a / 0.25, b / 0.75) AS total FROM c) SELECT CAST(least(a, round_even(total * 0.25, 0)) AS BIGINT) AS n_toxic, CAST(least(b, round_even(total * 0.75, 0)) AS BIGINT) AS n_clean FROM t")
def t12(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    row = lab.agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).first()
    a, b = s.rebalance(row["a"], row["b"], 0.25)
    tox = s.take(lab.where("toxic = 1").select("doc_id", "toxic"), a, SEED, "doc_id")
    clean = s.take(lab.where("toxic = 0").select("doc_id", "toxic"), b, SEED, "doc_id")
    return tox.union(clean).agg(F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("toxic") == 0).alias("n_clean"))


@query("t13_clean_plus_capped_hard", "SELECT doc_id, 'clean' AS kind FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT doc_id, 'hard' FROM (SELECT doc_id FROM labels WHERE NOT (quality = 1 AND toxic = 0) ORDER BY sha256('42|' || doc_id), doc_id LIMIT 30)")
def t13(spark: SparkSession, d: str) -> DataFrame:
    lab, clean = table(spark, d, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0)
    hard = s.take(lab.where(~clean).select("doc_id"), 30, SEED, "doc_id")
    return lab.where(clean).select("doc_id", F.lit("clean").alias("kind")).union(hard.select("doc_id", F.lit("hard")))


@query("t14_t15_mixture", "WITH c AS (SELECT count(*) FILTER (lang = 'en') / 0.6 AS a, count(*) FILTER (lang = 'fr') / 0.3 AS b, count(*) FILTER (lang = 'de') / 0.1 AS x FROM documents) SELECT CAST(ceil(greatest(a, b, x)) AS BIGINT) AS total, CAST(round_even(ceil(greatest(a, b, x)) * 0.6, 0) AS BIGINT) AS en FROM c")
def t14(spark: SparkSession, d: str) -> DataFrame:
    shares = s.ratios({"en": 6, "fr": 3, "de": 1, "es": -2})
    n = {r["lang"]: r["n"] for r in docs(spark, d).where(F.col("lang").isin("en", "fr", "de")).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = s.mixture_size(n, {k: round(v, 12) for k, v in shares.items()})
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(round(total * 0.6)).cast("long").alias("en"))


@query("t17_focus_ids", ROLL + ", s AS (SELECT group_id, list(rollout_id ORDER BY suitability, rollout_id) AS v FROM roll GROUP BY 1) SELECT group_id, v[1] AS lowest, v[len(v)] AS highest, v[len(v) // 2 + 1] AS middle FROM s")
def t17(spark: SparkSession, d: str) -> DataFrame:
    v = F.array_sort(F.collect_list(F.struct(F.col("suitability").alias("v"), F.col("rollout_id").cast("long").alias("i"))))
    return rollouts(spark, d).groupBy("group_id").agg(v.alias("v")).select("group_id", F.col("v")[0]["i"].alias("lowest"), F.element_at("v", -1)["i"].alias("highest"), F.get("v", F.floor(F.size("v") / 2).cast("int"))["i"].alias("middle"))


@query("t18_bernoulli", "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('42|' || doc_id), 1, 8))::BIGINT / 4294967295.0 < 0.2")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return s.bernoulli(docs(spark, d).select("doc_id"), 0.2, SEED, "doc_id")


@query("t19_epoch_batches", "WITH e AS (SELECT item_id, p, row_number() OVER (ORDER BY p, sha256('42|' || p || '|' || item_id), item_id) - 1 AS i FROM benchmark, range(2) t(p)) SELECT item_id, CAST(p AS INT) AS pass, CAST(i // 16 AS INT) AS batch FROM e")
def t19(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(1))))
    t = cu.dense_index(b.withColumn("h", cu.hash_order(SEED, F.col("pass"), F.col("item_id"))), [F.col("pass"), F.col("h"), F.col("item_id")], "i")
    return t.select("item_id", "pass", cu.batches(F.col("i"), 16)[0].alias("batch"))


@query("t20_random_tie_break", ROLL + "SELECT group_id, rollout_id FROM (SELECT group_id, rollout_id, row_number() OVER (PARTITION BY group_id ORDER BY suitability DESC, sha256('42|' || group_id || '|' || rollout_id)) AS rn FROM roll) WHERE rn = 1")
def t20(spark: SparkSession, d: str) -> DataFrame:
    t = rollouts(spark, d)
    best = F.min_by("rollout_id", F.struct(-F.col("suitability"), cu.hash_order(SEED, F.col("group_id"), F.col("rollout_id"))))
    return t.groupBy("group_id").agg(best.cast("long").alias("rollout_id"))


# Sources and sinks: written to the shared folder, read back, and held against the table.


@query("s1_k1_jsonl_round_trip", "SELECT item_id, text FROM benchmark")
def s1(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select("item_id", "text")
    return files.read_jsonl(spark, files.write_jsonl(t, files.scratch(spark, "jsonl")), t.schema)


@query("s2b_first_rows", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 7")
def s2b(spark: SparkSession, d: str) -> DataFrame:
    return files.first_rows(table(spark, d, "benchmark"), 7, "item_id")


@query("s3_json_or_jsonl", "SELECT item_id, text FROM benchmark")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """One folder with files of lines, of an array, and of one object over several lines."""
    t, path = table(spark, d, "benchmark").select("item_id", "text"), files.scratch(spark, "mixed")
    one = t.agg(F.min("item_id")).first()[0]
    shown = F.concat(F.lit("{\n  \"item_id\": "), "item_id", F.lit(",\n  \"text\": "), F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1), F.lit("\n}"))
    files.write_text(spark, t.where(F.col("item_id") == one).select(shown.alias("value")), f"{path}/object")
    files.write_text(spark, files.to_json_array(t.where((F.col("item_id") != one) & (F.col("item_id") % 2 == 0))), f"{path}/array")
    files.write_jsonl(t.where((F.col("item_id") != one) & (F.col("item_id") % 2 != 0)), f"{path}/lines")
    return files.read_json_any(spark, path, t.schema)


@query("s4_optional_scan", "SELECT item_id, text FROM benchmark")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Of two optional files one is there."""
    t, path = table(spark, d, "benchmark").select("item_id", "text"), files.scratch(spark, "optional")
    files.write_jsonl(t, f"{path}/there")
    return files.read_optional(spark, f"{path}/missing", t.schema).union(files.read_optional(spark, f"{path}/there", t.schema))


@query("s6_k6_partitioned_files", "SELECT doc_id, lang, 'lang=' || lang AS folder FROM documents")
def s6(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "parts")
    docs(spark, d).select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    return files.discover(spark, path).select("doc_id", "lang", F.regexp_extract("source_file", "(lang=[^/]*)/", 1).alias("folder"))


@query("s9_line_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n").union(table(spark, d, "benchmark").agg(F.count("*").alias("n")).select(F.lit("benchmark"), "n"))


@query("k2_append", "SELECT item_id, text FROM benchmark")
def k2(spark: SparkSession, d: str) -> DataFrame:
    t, path = table(spark, d, "benchmark").select("item_id", "text"), files.scratch(spark, "append")
    for k in (0, 1):
        files.write_jsonl(t.where(F.col("item_id") % 2 == k), path, "append")
    return files.read_jsonl(spark, path, t.schema)


@query("k4_csv_report", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def k4(spark: SparkSession, d: str) -> DataFrame:
    t, path = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")), files.scratch(spark, "csv")
    files.write_csv(t, path)
    return spark.read.option("header", True).schema(t.schema).csv(path)


WORDS = ", ".join(f"CAST(coalesce(sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::DECIMAL(20, 0)), 0) AS VARCHAR)" for i in range(4))


@query("k7_content_digest", f"SELECT sha256(concat_ws('|', count(*), {WORDS})) AS digest FROM (SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey)) AS h FROM lineitem)")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return files.digest(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("s2_objects_only", "SELECT conv_id, turn, role, text FROM conversations")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Rows under an explicit schema, one object a line, between blank lines; arrays and other values fail (see the tests)."""
    t, path = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), files.scratch(spark, "objects")
    files.write_text(spark, t.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(" "))).alias("value")), path)
    return files.read_jsonl(spark, path, t.schema)


@query("s5_splits", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """A dataset kept as JSON lines per split, read back with the split as a column."""
    path = files.scratch(spark, "splits")
    parts = []
    for split, test in (("test", F.col("doc_id") % 10 == 0), ("train", F.col("doc_id") % 10 != 0)):
        t = docs(spark, d).where(test).select("doc_id")
        parts.append(files.read_jsonl(spark, files.write_jsonl(t, f"{path}/{split}"), t.schema).withColumn("split", F.lit(split)))
    return parts[0].union(parts[1])


@query("p13_result_row", ROLL + "SELECT group_id AS index, 'run' || run AS model_label, rollout_id, answer_correctness = 1 AS correct, error_type AS verification_method FROM roll")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).select(F.col("group_id").alias("index"), F.concat(F.lit("run"), "run").alias("model_label"), "rollout_id", (F.col("answer_correctness") == 1).alias("correct"), F.col("error_type").alias("verification_method"))


@query("p16_condition", ROLL + "SELECT group_id, rollout_id FROM roll WHERE run = 1 AND answer_correctness = 0 AND step_validity > 2")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).where("run = 1 and answer_correctness = 0 and step_validity > 2").select("group_id", "rollout_id")


@query("k3_json_summary", """SELECT '{' || chr(10) || '  "langs": ' || count(DISTINCT lang) || ',' || chr(10) || '  "longest": ' || max(n_chars) || ',' || chr(10) || '  "n": ' || count(*) || chr(10) || '}' AS summary FROM documents""")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return files.summaries(docs(spark, d).agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest")))


@query("k5_markdown_rows", "SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang")
def k5(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")).select(F.format_string("| %s | %d |", "lang", "n").alias("line"))
