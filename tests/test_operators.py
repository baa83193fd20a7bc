import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import curate, groups, rewards, sampling
from tarnfold.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_posterior_sums_to_one_and_falls_back(spark):
    t = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0), ("b", 0, 1.0), ("c", 0, 0.2), ("c", 1, 0.6), ("d", 0, float("nan")), ("d", 1, 1.0)], "group_id string, rollout_id int, x double")
    p, bad = groups.normalise(F.col("x"), groups.group("group_id"))
    got = {(r.group_id, r.rollout_id): (r.p, r.bad) for r in t.select("group_id", "rollout_id", p.alias("p"), bad.alias("bad")).collect()}
    assert got["a", 0] == (0.5, True) and got["d", 1] == (0.5, True) and got["b", 0] == (1.0, False)
    assert got["c", 1][0] == pytest.approx(0.75)


def test_lambda_zero_is_likelihood_only(spark):
    t = spark.createDataFrame([("a", 0, 0.0, 0.3), ("a", 1, 1.0, 0.1)], "g string, i int, prior double, like double")
    p, _ = groups.posterior(F.col("prior"), F.col("like"), groups.group("g"), 0.0)
    assert [round(r[0], 9) for r in t.orderBy("i").select(p).collect()] == [0.75, 0.25]


def test_dense_index_is_dense(spark):
    t = spark.range(1000).withColumn("h", F.xxhash64("id"))
    got = [r.i for r in curate.dense_index(t, [F.col("h")], "i").orderBy("h").collect()]
    assert got == list(range(1000))


def test_dense_index_beyond_the_range_sampler(spark):
    """Many partitions and rows, and a column that only one side of the count reads."""
    t = spark.range(1_000_000).withColumn("h", F.xxhash64("id")).withColumn("wide", F.sha2(F.col("id").cast("string"), 256))
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        got = curate.dense_index(t, [F.col("h")], "i")
        n, distinct, least, most = got.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
        assert (n, distinct, least, most) == (1_000_000, 1_000_000, 0, 999_999)
        few = got.where("i < 100000 and i % 1000 = 0").select("i", "h", "wide").collect()
        assert all(r.wide for r in few) and [r.h for r in sorted(few)] == sorted(r.h for r in few)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_first_n_of_any_size(spark, monkeypatch):
    t = spark.range(5000).select("id", curate.hash_order(7, F.col("id") % 4000).alias("h"))  # a fifth of the hashes come twice
    want = sorted((r.h, r.id) for r in t.collect())
    monkeypatch.setattr(curate, "EDGE", 20)
    for n in (0, 1, 19, 1234, 4999, 5000, 9000):
        certain, edge = curate.first_n(t, n, "h", "id")
        assert sorted((r.h, r.id) for r in certain.union(edge).collect()) == want[:n] and edge.count() <= 20
    same = spark.range(300).select("id", F.sha2(F.lit("x"), 256).alias("h"))
    certain, edge = curate.first_n(same, 120, "h", "id")
    assert certain.count() == 0 and sorted(r.id for r in edge.collect()) == list(range(120))


def test_scan_that_misses_its_target_goes_on_to_the_end(spark):
    t = spark.createDataFrame([(i, f"k{i % 5}", i % 7 == 0) for i in range(40)], "id long, k string, bad boolean")
    reason = F.when(F.col("bad"), "bad")
    for target in (3, 5, 6, 100):
        got = {r.id: r.outcome for r in curate.scan_select(t, reason, "k", curate.hash_order(1, F.col("id")), "id", target).collect()}
        order, kept, want = sorted(t.withColumn("o", curate.hash_order(1, F.col("id"))).collect(), key=lambda r: (r.o, r.id)), set(), {}
        for r in order:
            want[r.id] = "unscanned" if len(kept) == target else "bad" if r.bad else "duplicate" if r.k in kept else "selected"
            kept |= {r.k} if want[r.id] == "selected" else set()
        assert got == want


def test_containing_against_brute_force(spark):
    docs = [(1, "the cat sat on the mat"), (2, "bathe cat sat on the matter"), (3, "the  cat sat on the mat"), (4, None), (5, ""), (6, "x yes"), (7, "cat\nsat on"), (1, "no")]
    items = [("the cat sat on the mat",), ("he cat sat on the mat",), ("cat sat on",), ("cat\nsat o",), ("x y",), ("q",), ("",), (None,), ("a b c d e f g h i",)]
    for keep in (items[:5], items[:4] + items[8:], items[4:6], items, [], [(None,)]):
        d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(keep, "item string")
        want = {k for k, t in docs if t is not None and any(x is not None and x in t for (x,) in keep)}
        assert sorted(r.doc_id for r in curate.containing(d, i, "doc_id", "text", "item").collect()) == sorted(want)


def test_split_is_stable(spark):
    t = spark.range(500).withColumn("s", curate.hash_split(F.col("id"), 0.2))
    assert rows(t) == rows(t.repartition(7))
    assert 60 < t.where("s = 'val'").count() < 140


def test_oversample(spark):
    t = spark.range(10)
    got = sampling.oversample(t, 25, 1, "id")
    assert got.count() == 25
    assert {r["count"] for r in got.groupBy("id").count().collect()} == {2, 3}
    assert sampling.oversample(t.limit(0), 5, 1, "id").count() == 0


@pytest.mark.parametrize("line", ["not json", '[{"a": 2}, {"a": 3}]', "7", '"text"', '{"a": "x"', '{"a": "word"}'])
def test_lines_that_are_no_objects_fail(spark, tmp_path, line):
    path = f"file://{tmp_path}/x.jsonl"
    schema = spark.createDataFrame([], "a int").schema
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  {"a": null, "b": 2}\n')
    assert sorted(files.read_jsonl(spark, path, schema).collect(), key=str) == [(1,), (None,)]
    (tmp_path / "x.jsonl").write_text(f'{{"a": 1}}\n\n{line}\n')
    with pytest.raises(Exception, match=r"(?s)Malformed line.*x\.jsonl:3: "):
        files.read_jsonl(spark, path, schema).collect()
    lines = spark.read.text(path).withColumn("_file", F.lit(path))  # for stores that Arrow can't open
    with pytest.raises(Exception, match=r"(?s)Malformed line.*x\.jsonl: "):
        files.parse_lines(lines, schema).collect()


def test_digest_tells_tables_apart(spark):
    one = lambda t: files.digest(t, "id").first()[0]
    assert one(spark.range(100)) == one(spark.range(100).repartition(3)) != one(spark.range(99)) and one(spark.range(0))


def test_markdown():
    from pyspark.sql import Row

    assert files.markdown([Row(a=None, b=0.5)], ["a", "b"]) == "| a | b |\n| --- | --- |\n| - | 0.5000 |\n"


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_rewards_of_groups_that_batches_cut(spark, monkeypatch, batch):
    """A call has the groups of a batch; groups over several batches, null keys, bad values and single rows stay apart."""
    rows = []
    for g in (None, *range(12)):
        k = g or 0
        rows += [(g, i, (5 * k + i) % 4, None if k == 3 and i == 1 else ((7 * k + i) % 5) / 4) for i in range(1 + 5 * k % 8)]
    t = spark.createDataFrame(rows, "g int, i int, suitability int, likelihood double").repartition(3)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, batch)
    try:
        got = {(r.g, r.i): r for r in rewards.apply(t, "posterior", ("g",), "i").collect()}
        loo = {(r.g, r.i): r.advantage for r in rewards.apply(t.fillna(0.0, ["likelihood"]).withColumn("reward", F.col("likelihood")), "leave_one_out", ("g",), "i").collect()}
    finally:
        spark.conf.unset(conf)
    assert len(got) == len(loo) == len(rows)
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        e = [math.exp(r[2]) for r in own]
        x = [None if r[3] is None else a / sum(e) * r[3] for a, r in zip(e, own, strict=True)]
        bad = None in x or sum(x) <= 0
        like = [r[3] or 0.0 for r in own]
        for k, r in enumerate(own):
            assert got[g, r[1]].fallback == bad
            assert got[g, r[1]].posterior == pytest.approx(1 / len(own) if bad else x[k] / sum(x))
            others = like[:k] + like[k + 1 :]
            assert loo[g, r[1]] == pytest.approx(like[k] - sum(others) / len(others) if others else 0.0)


def test_rewards_call_python_by_the_batch(spark):
    @rewards.register("test_calls", ("x",), "calls long", many=True)
    def calls(groups, x):
        return {"calls": np.full(len(x), len(groups.starts))}

    try:
        t = spark.range(4000).select((F.col("id") % 1000).alias("g"), "id", F.lit(1.0).alias("x"))
        assert rewards.apply(t, "test_calls", ("g",), "id").agg(F.max("calls")).first()[0] > 100
    finally:
        del rewards.REGISTRY["test_calls"]


def test_rollouts_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """A task's rows don't grow with the table: as many tasks as the rows ask for, whole groups in each, and no second deal for what follows."""
    from tarnfold.plans import base, reports

    want = rows(base.rollouts(spark, sf_dir))
    monkeypatch.setattr(base, "ROWS", 500)
    t = base.rollouts(spark, sf_dir)
    assert rows(t) == want
    tasks = t.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.collect_set("group_id").alias("g")).collect()
    assert len(tasks) >= len(want) / 500 / 2 and max(r.n for r in tasks) < 2 * 500 + 50
    assert sum(len(r.g) for r in tasks) == len({r[0] for r in want})
    plan = reports.a15(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(group_id" not in plan


def test_pools_of_mixtures_are_made_once(spark):
    """Counting, cutting and passing read what was written; the rows are not made again for each."""
    from tarnfold.operators import examples as ex

    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return True

    pool = lambda n: spark.range(n).where(F.udf(seen, "boolean").asNondeterministic()("id")).select(F.col("id").cast("string").alias("example_id"))
    assert ex.mixture(pool(300), pool(100), {"evidence": 1.0, "prior": 1.0}, 1).count() == 600
    assert made.value == 400
    made.value = 0
    pools = pool(200).select(F.when(F.col("example_id") % 2 == 0, "evidence").otherwise("prior").alias("task"), F.lit("b").alias("bucket"), "example_id")
    assert ex.bucket_mixture(pools, {"b": 1.0}, {"evidence": 1.0, "prior": 1.0}, 1)[0].count() == 200
    assert made.value == 200


def test_learned_judgments_are_dealt_to_the_tasks_asked_for(spark):
    from tarnfold.operators import preferences

    t = spark.range(40).select((F.col("id") % 10).cast("string").alias("problem"), (F.col("id") % 4).cast("int").alias("rollout_id"))
    learned = t.where("problem < '5'").withColumn("at", F.monotonically_increasing_id())
    got = preferences.with_learned(t, learned, "at", 9)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert got.rdd.getNumPartitions() == 9
    assert rows(got) == rows(preferences.with_learned(t, learned, "at"))


def test_candidates_are_not_framed_row_by_row(spark):
    from tarnfold.functions import text

    text.register_functions(spark)
    spark.createDataFrame([("the answer is 4",)], "t string").createOrReplaceTempView("said")
    plan = spark.sql("SELECT c.* FROM said, LATERAL answer_candidates(t) c")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" not in plan and "BatchEvalPythonUDTF" in plan
