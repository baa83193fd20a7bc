"""The closed loop of belief-guided choice: each record's strategy is the one believed best after all earlier choices of its key.

A choice reads the state that earlier choices wrote, so a key's records are taken one after the other, in order; keys are independent. The state of a
key is three numbers per strategy (alpha, beta, trials), held by Spark's state store: it survives restarts, and a batch is the same
computation with an empty state to begin with. Within a micro-batch a key's records are ordered by `order`; micro-batches follow one another, so a
source whose files come in order gives the batch's result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([T.StructField("alpha", T.ArrayType(T.DoubleType())), T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("trials", T.ArrayType(T.LongType()))])


def tie_order(seed: int, key: object, record: object, name: str) -> str:
    """Where two strategies are believed equal, the one of the lower hash is chosen: a random choice that can be repeated."""
    return hashlib.sha256(f"{seed}|{key}|{record}|{name}".encode()).hexdigest()


class Chooser(StatefulProcessor):
    """(key, record, rewards of all strategies) -> the choice, the belief it was made on, and the reward that came back."""

    def __init__(self, strategies: list[str], key: str, record: str, order: list[str], rewards: str, seed: int) -> None:
        self.strategies, self.key, self.record, self.order, self.rewards, self.seed = strategies, key, record, order, rewards, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("beliefs", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = len(self.strategies)
        held = self.state.get() if self.state.exists() else ([1.0] * n, [1.0] * n, [0] * n)
        alpha, beta, trials = (list(x) for x in held)
        given = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for record, rewards in zip(given[self.record], given[self.rewards], strict=True):
            belief = [a / (a + b) for a, b in zip(alpha, beta, strict=True)]
            best = [i for i in range(n) if belief[i] == max(belief)]
            if len(best) > 1:
                best.sort(key=lambda i: tie_order(self.seed, key[0], record, self.strategies[i]))
            i = best[0]
            reward = min(1.0, max(0.0, float(rewards[i])))
            out.append((key[0], record, self.strategies[i], belief[i], reward, trials[i]))
            alpha[i] += reward
            beta[i] += 1.0 - reward
            trials[i] += 1
        self.state.update((alpha, beta, trials))
        yield pd.DataFrame(out, columns=[self.key, self.record, "strategy", "belief", "reward", "trials"])

    def close(self) -> None:
        pass


def choose_and_learn(df: DataFrame, strategies: list[str], key: str, record: str, order: list[str], rewards: str, seed: int = 42) -> DataFrame:
    """key, record, strategy, belief (before), reward, trials (before) for each row of a table or a stream. `rewards`: array, one per strategy."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(record, kinds[record]), T.StructField("strategy", T.StringType()), T.StructField("belief", T.DoubleType()), T.StructField("reward", T.DoubleType()), T.StructField("trials", T.LongType())])
    spark = df.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(store, ""):  # the only store with keyed state of several kinds
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active  # a session's first use of streams starts what state stores report to; a batch alone doesn't
    columns = list(dict.fromkeys([key, record, *order, rewards]))
    processor = Chooser(strategies, key, record, order, rewards, seed)
    return df.select(*columns).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")
