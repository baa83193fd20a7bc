"""Rewards as named group functions: a group of rollouts goes in as arrays, its rows come out with what the function adds.

A second way to compute the rewards of operators.groups, independent of it, and the place where a caller's own rewards plug in. Groups are
numbered in order by a window, and a task cuts the Arrow batches that pass through it where a group starts. So a call into Python has the groups of
a batch, not one; a group has to fit in a task, as in operators.groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Reward(NamedTuple):
    needs: tuple[str, ...]
    adds: str
    call: Callable[..., dict[str, np.ndarray]]
    many: bool = False


REGISTRY: dict[str, Reward] = {}


def register(name: str, needs: tuple[str, ...], adds: str, many: bool = False):  # noqa: ANN201
    """A function of the needed columns as arrays -> the added columns as arrays, for one group. With `many`, for whole groups that follow one another: it gets a Groups first."""

    def add(call: Callable[..., dict[str, np.ndarray]]) -> Callable[..., dict[str, np.ndarray]]:
        if name in REGISTRY:
            raise ValueError(f"reward {name} is there already")
        REGISTRY[name] = Reward(needs, adds, call, many)
        return call

    return add


class Groups:
    """Groups that follow one another, by where each starts, and their sums and maxima, given back to each row."""

    def __init__(self, starts: np.ndarray, rows: int) -> None:
        self.starts = starts
        self.sizes = np.diff(np.append(starts, rows))

    def spread(self, per_group: np.ndarray) -> np.ndarray:
        return np.repeat(per_group, self.sizes)

    @property
    def n(self) -> np.ndarray:
        return self.spread(self.sizes)

    def sum(self, x: np.ndarray) -> np.ndarray:
        return self.spread(np.add.reduceat(x, self.starts))

    def max(self, x: np.ndarray) -> np.ndarray:
        return self.spread(np.maximum.reduceat(x, self.starts))

    def all(self, x: np.ndarray) -> np.ndarray:
        return self.spread(np.logical_and.reduceat(x, self.starts))

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over the group's sum; uniform, and True, where a value of the group is bad or the sum isn't positive."""
        sound = self.all(np.isfinite(x) & (x >= 0))
        total = self.sum(np.where(sound, x, 0.0))
        fine = np.isfinite(total) & (total > 0)
        return np.where(fine, x / np.where(fine, total, 1.0), 1.0 / self.n), ~fine


def apply(df: DataFrame, name: str, keys: tuple[str, ...], index: str, **parameters: float) -> DataFrame:
    """keys, index and the reward's columns, for each row; a group's rows are in the order of their index."""
    reward = REGISTRY[name]
    columns = list(dict.fromkeys([*keys, index, *reward.needs]))
    kept = [*keys, index]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in kept], reward.adds])
    names = [x.split()[0] for x in reward.adds.split(", ")]

    def rewarded(t: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(t.column("_at").to_numpy() == 1)
        given = [t.column(c).to_numpy() for c in reward.needs]
        if reward.many:
            got = reward.call(Groups(starts, t.num_rows), *given, **parameters)
        else:
            each = [reward.call(*group, **parameters) for group in zip(*(np.split(x, starts[1:]) for x in given), strict=True)]
            got = {n: np.concatenate([e[n] for e in each]) for n in names}
        yield from pa.table([*[t.column(c) for c in kept], *[pa.array(got[n]) for n in names]], names=[*kept, *names]).combine_chunks().to_batches()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that the last batch has left open
        before = 0
        for batch in it:
            if not batch.num_rows:
                continue
            at = batch.column(batch.schema.get_field_index("_at")).to_numpy()
            if ((at != 1) & (at != np.append(before, at[:-1]) + 1)).any():
                raise ValueError("a group's rows don't follow one another")
            before = at[-1]
            starts = np.flatnonzero(at == 1)
            if len(starts):
                whole = [*held, batch.slice(0, starts[-1])]
                if sum(b.num_rows for b in whole):
                    yield from rewarded(pa.Table.from_batches(whole))
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from rewarded(pa.Table.from_batches(held))

    # the window wants a key's rows together and in order, which holds whatever is done to the plan while it runs
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index)).alias("_at")
    return df.select(*columns, place).mapInArrow(run, schema)


@register("posterior", ("suitability", "likelihood"), "posterior double, fallback boolean", many=True)
def posterior(groups: Groups, suitability: np.ndarray, likelihood: np.ndarray, power: float = 1.0) -> dict[str, np.ndarray]:
    """Prior by softmax of suitability, to a power, times likelihood."""
    e = np.exp(suitability.astype(np.float64) - groups.max(suitability))
    p, fallback = groups.shares((e / groups.sum(e)) ** power * likelihood)
    return {"posterior": p, "fallback": fallback}


@register("tempered_posterior", ("suitability", "likelihood"), "posterior double, fallback boolean", many=True)
def tempered_posterior(groups: Groups, suitability: np.ndarray, likelihood: np.ndarray, power: float = 0.5) -> dict[str, np.ndarray]:
    """The same with a prior that is made whole again after the power."""
    e = np.exp(suitability.astype(np.float64) - groups.max(suitability))
    prior, _ = groups.shares((e / groups.sum(e)) ** power)
    p, fallback = groups.shares(prior * likelihood)
    return {"posterior": p, "fallback": fallback}


@register("entropy", ("posterior",), "entropy double", many=True)
def entropy(groups: Groups, p: np.ndarray) -> dict[str, np.ndarray]:
    """Of the group's distribution, over the logarithm of its size."""
    live = p > 0
    h = -groups.sum(np.where(live, p * np.log(np.where(live, p, 1.0)), 0.0))
    return {"entropy": np.where(groups.n > 1, h / np.log(np.maximum(groups.n, 2)), 0.0)}


@register("leave_one_out", ("reward",), "advantage double", many=True)
def leave_one_out(groups: Groups, reward: np.ndarray) -> dict[str, np.ndarray]:
    """A reward less the mean of the others' rewards; of a single one 0."""
    n = groups.n
    return {"advantage": np.where(n > 1, reward - (groups.sum(reward) - reward) / np.maximum(n - 1, 1), 0.0)}
