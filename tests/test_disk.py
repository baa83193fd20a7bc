"""Mixtures of examples hold ids once on disk, as bytes; the parts they are made of against plain ways."""

import hashlib
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import curate, sampling
from tarnfold.plans import registry


def on_disk(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


@pytest.fixture
def tables(tmp_path, monkeypatch):
    """A folder for the tables that operators write."""
    for module in (curate, sampling):
        monkeypatch.setattr(module, "scratch", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    return tmp_path


def test_bucket_mixture_holds_ids_once_on_disk(spark, tables):
    """Disk grows with an example's digest once, as bytes, and with a short row for each use."""
    from tarnfold.operators import examples as ex

    n, uses = 20_000, 4
    pools = spark.range(n).select(F.when(F.col("id") % 2 == 0, "evidence").otherwise("prior").alias("task"), F.lit("b").alias("bucket"), F.sha2(F.col("id").cast("string"), 256).alias("example_id"))
    mixed, parts = ex.bucket_mixture(pools.union(pools), {"b": 1.0}, {"evidence": 1.0, "prior": 1.0}, 1, uses * n)
    assert on_disk(tables) < 44 * n + 20 * uses * n
    assert parts == {("evidence", "b"): uses * n // 2, ("prior", "b"): uses * n // 2}
    assert sorted(r["index"] for r in mixed.select("index").collect()) == list(range(uses * n))
    per = mixed.groupBy("task", "example_id").agg(F.count("*").alias("n"), F.count_distinct("pass").alias("p"))
    assert per.count() == n and per.where(f"n <> {uses} or p <> {uses}").count() == 0
    assert per.join(pools, ["task", "example_id"], "left_anti").count() == 0
    order = [r.h for r in mixed.orderBy("index").select(curate.hash_order(1, F.lit("place"), F.col("task"), F.col("bucket"), F.col("pass"), F.col("example_id")).alias("h")).collect()]
    assert order == sorted(order)


def test_assembled_mixture_holds_ids_once_on_disk(spark, tables):
    from tarnfold.operators import examples as ex

    n, uses = 20_000, 4
    pools = spark.range(n).select(F.when(F.col("id") % 2 == 0, "evidence").otherwise("prior").alias("task"), F.when(F.col("id") % 3 == 0, "a").otherwise("c").alias("source"), F.when(F.col("id") % 10 < 8, "train").otherwise("val").alias("split"), F.sha2(F.col("id").cast("string"), 256).alias("example_id"))
    t = ex.assemble(pools, ["c", "a"], {"evidence": 1.0, "prior": 1.0}, 1, uses * n)
    assert on_disk(tables) < 44 * n + 20 * (uses * n + n // 5)
    val = [(r.task, r.source, r.example_id) for r in t.where("split = 'val'").orderBy("index").collect()]
    assert val == sorted(((r.task, r.source, r.example_id) for r in pools.where("split = 'val'").collect()), key=lambda r: (r[0], "ca".index(r[1]), r[2]))
    train = t.where("split = 'train'")
    assert sorted(r["index"] for r in train.select("index").collect()) == list(range(uses * n))
    assert {r["n"] for r in train.groupBy("task", "source", "example_id").agg(F.count("*").alias("n")).collect()} == {5}
    assert train.join(pools.where("split = 'train'"), ["task", "source", "example_id"], "left_anti").count() == 0


def test_copies_in_passes(spark):
    """Copies of an example are used one by one; the last, partial pass takes the first of them in the order of its hashes."""
    names = ["a", "a", "a", "b", "c", "c", "d|x", "00ff", None]
    t = spark.createDataFrame([(x,) for x in names], "id string")
    got = sampling.oversample(t, 22, 5, "id").collect()
    h = {(p, x): hashlib.sha256("|".join(["5", str(p), *([x] if x is not None else [])]).encode()).hexdigest() for p in range(3) for x in set(names)}
    third = sorted(names, key=lambda x: h[2, x])[:4]
    want = Counter(names + names + third)
    assert Counter(r.id for r in got) == want
    assert sorted((r.id or "", r.instance) for r in got) == sorted((x or "", i) for x, k in want.items() for i in range(k))
    assert Counter(r.id for r in got if r["pass"] == 2) == Counter(third)


def test_packed_texts(spark):
    texts = ["ab", "abc", "AB", "", "00ff" * 16, "x|日本", None, "12", "ab" * 100_000, "ab\n"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, x string").withColumn("p", curate.packed(F.col("x")))
    got = t.select("i", "p", curate.unpacked(F.col("p")).alias("x")).collect()
    assert [r.x for r in sorted(got)] == texts
    assert {len(r.p) for r in got if r.i in (4, 8)} == {33, 100_001} and len({bytes(r.p) for r in got if r.p is not None}) == len(texts) - 1


def test_dense_counts(spark):
    index = {"whole": range(70_000), "gap": [0, 2], "twice": [0, 1, 1, 3], "late": [1, 2], "one": [0]}
    t = spark.createDataFrame([(k, i % 2, i) for k, v in index.items() for i in v], "k string, o int, i long")
    counts, dense = curate.dense_counts(t, "i", ["k"], "o")
    assert {r.k: r.indices for r in dense.collect()} == {"whole": 70_000, "gap": None, "twice": 3, "late": None, "one": 1}
    assert {(r.k, r.o): r.n for r in counts.collect()} == Counter((k, i % 2) for k, v in index.items() for i in v)


def test_kept_rows_leave_no_shuffle(spark, tables):
    known = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before, was = known(), spark.conf.get(curate.CLEANUP)
    t = curate.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "k")
    until = time.time() + 20
    while known() > before and time.time() < until:
        time.sleep(0.1)
    assert known() <= before and spark.conf.get(curate.CLEANUP) == was
    assert t.count() == 7


@pytest.mark.parametrize("name", ["l14_bucket_mixture", "l14_sources"])
def test_tables_of_mixture_queries(name, spark, sf_dir, tables):
    """Short against the rollouts that they are made of."""
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
    assert on_disk(tables) < 80 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
