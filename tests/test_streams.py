"""Streams that fail and start again: the log holds each record once, choices are those of one sequential pass, progress adds up."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tarnfold.streaming import log, loop, progress

NAMES = ["a", "b", "c"]


def drop(spark, inbox, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)


def source(spark, inbox, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)


def test_log_holds_each_record_once_after_failures(spark, tmp_path):
    inbox, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "log", "at"))
    schema = spark.createDataFrame([], "id long, text string, w double").schema
    for k in range(4):
        drop(spark, inbox, [(10 * k + i, f'"{i}"\n\\frac \u2028', i / 3) for i in range(5)], schema)
    failed = []

    def lose(number):  # after the data, before the ledger
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        log.append(source(spark, inbox, schema), out, at, before_entry=lose).awaitTermination()
    assert log.Ledger(spark, out).batches() == [0]
    assert log.read(spark, out, schema).count() == 5  # the half-written batch isn't seen
    log.append(source(spark, inbox, schema), out, at).awaitTermination()
    drop(spark, inbox, [(99, None, None)], schema)
    log.append(source(spark, inbox, schema), out, at).awaitTermination()
    got = log.read(spark, out, schema)
    want = spark.read.parquet(inbox)
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect())) and got.count() == 21
    assert log.Ledger(spark, out).batches() == [0, 1, 2, 3, 4]


def test_a_batch_in_the_ledger_is_passed_over(spark, tmp_path):
    out = f"file://{tmp_path}/log"
    ledger = log.Ledger(spark, out)
    ledger.enter(3)
    assert ledger.holds(3) and not ledger.holds(2) and ledger.batches() == [3]
    with pytest.raises(FileExistsError):
        ledger.enter(3)
    schema = spark.createDataFrame([], "id long").schema
    assert log.read(spark, f"file://{tmp_path}/none", schema).count() == 0


def sequential(rows, seed=42):
    """(key, record) -> (strategy, belief), one record after the other."""
    state, out = {}, {}
    for key, record, _, rewards in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = state.setdefault(key, {n: [1.0, 1.0] for n in NAMES})
        belief = {n: mine[n][0] / sum(mine[n]) for n in NAMES}
        best = [n for n in NAMES if belief[n] == max(belief.values())]
        name = min(best, key=lambda n: hashlib.sha256(f"{seed}|{key}|{record}|{n}".encode()).hexdigest()) if len(best) > 1 else best[0]
        reward = min(1.0, max(0.0, rewards[NAMES.index(name)]))
        out[key, record] = (name, belief[name], reward)
        mine[name][0] += reward
        mine[name][1] += 1.0 - reward
    return out


def test_closed_loop_in_batch_and_over_restarts(spark, tmp_path):
    rows = [(i % 3, i, i // 2, [(i * (k + 3) % 7) / 6.0 - 0.1 * (i % 5 == 0) for k in range(3)]) for i in range(120)]
    schema = spark.createDataFrame([], "key long, record long, at long, rewards array<double>").schema
    want = sequential(rows)
    shape = lambda df: {(r.key, r.record): (r.strategy, r.belief, r.reward) for r in df.collect()}
    choose = lambda df: loop.choose_and_learn(df, NAMES, "key", "record", ["at", "record"], "rewards")
    assert shape(choose(spark.createDataFrame(rows[::-1], schema).repartition(5))) == want

    inbox, at, out = (f"file://{tmp_path}/{x}" for x in ("in", "at", "out"))
    for part in (rows[:50], rows[50:80], rows[80:]):  # each start of the stream goes on from the state that the last one left
        drop(spark, inbox, part, schema)
        choose(source(spark, inbox, schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert shape(spark.read.parquet(out)) == want


def test_progress_adds_up(spark, tmp_path):
    inbox = f"file://{tmp_path}/in"
    schema = spark.createDataFrame([], "id long").schema
    with progress.Progress(spark) as seen:
        for k in range(3):
            drop(spark, inbox, [(i,) for i in range(10 * k, 10 * k + 7)], schema)
            stream = source(spark, inbox, schema).observe("m", F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
            seen.wait(log.append(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/at", "mine"))
        got = [r for r in seen.table().collect() if r.input_rows]
    assert [(r.query, r.input_rows, r.metrics["m.n"]) for r in got] == [("mine", 7, 7.0)] * 3
    assert max(r.metrics["m.most"] for r in got) == 26


def test_both_halves_of_the_events_arrive_once(spark, tmp_path, monkeypatch):
    """Also with events without a time, and where a second approximation of the middle time is another one."""
    import datetime

    from tarnfold.plans import labels

    day = lambda i: None if i % 10 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [(i, day(i), i % 3, "click" if i % 2 else "view", float(i), "") for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    middles = iter([0.5, 0.9, 0.5, 0.1])
    real = F.percentile_approx
    monkeypatch.setattr(labels.F, "percentile_approx", lambda c, *_: real(c, next(middles)))
    got = {r.event_type: (r.trials, r.alpha) for r in labels.z1(spark, str(tmp_path)).collect()}
    assert got == {"click": (50, 26.0), "view": (50, 26.0)}
    middles = iter([0.5, 0.9])
    seen = labels.z6(spark, str(tmp_path)).first()
    assert (seen.input_rows, seen.observed_rows, seen.observed_reward) == (100, 100.0, 50.0)
