"""Reductions of ragged arrays, as kernels on Arrow's offsets and flat values: masked sums and means of token values, masked pooling of token vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values as doubles, nulls as NaN; row of each value)."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lengths)


def masked(values: pa.Array, mask: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sum of values where the mask is on, how many are on) for each row; the mask is as long as the values."""
    x, row = _flat(values)
    on, other = _flat(mask)
    if len(x) != len(on) or (row != other).any():
        raise ValueError("values and mask differ in length")
    keep = on > 0
    return np.bincount(row[keep], weights=x[keep], minlength=len(values)), np.bincount(row[keep], minlength=len(values))


@F.arrow_udf(T.StructType([T.StructField("total", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("tokens", T.LongType())]))
def token_sums(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Masked sum, mean (over 1 at least) and number of tokens; 0 for null."""
    for values, mask in it:
        total, n = masked(values, mask)
        yield pa.StructArray.from_arrays([pa.array(total), pa.array(total / np.maximum(n, 1)), pa.array(n.astype(np.int64))], ["total", "mean", "tokens"])


def logp_reward(logps: Column, mask: Column, mode: str = "sum_exp", scale: float = 1.0, lo: float = -80.0) -> Column:
    """Reward of an answer from its tokens' log probabilities: 0 without tokens; else the masked sum or mean, as it is or as a clamped exponential."""
    s = token_sums(logps, mask)
    x = s["total"] if mode.startswith("sum") else s["mean"]
    value = F.exp(F.greatest(F.least(x, F.lit(0.0)), F.lit(lo))) if mode.endswith("exp") else x
    return F.when(s["tokens"] > 0, scale * value).otherwise(0.0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def pool(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Mean of the token vectors (array<array<number>>) whose mask is on, scaled to length 1; zeros where none is on. A row's vectors have one length."""
    for vectors, mask in it:
        tokens = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        on, row = _flat(mask)
        inner = vectors.flatten()
        x, place = _flat(inner)
        if len(row) != len(inner):
            raise ValueError("vectors and mask differ in length")
        width = np.bincount(place, minlength=len(inner)).astype(np.int64)  # of each token
        starts = np.cumsum(tokens) - tokens
        dim = np.where(tokens > 0, width[np.minimum(starts, max(0, len(width) - 1))], 0) if len(width) else np.zeros(len(tokens), dtype=np.int64)
        if (width != dim[row]).any():
            raise ValueError("a row's vectors differ in length")
        begin = np.cumsum(dim) - dim  # of each row's pooled vector
        component = np.arange(len(x)) - np.repeat(np.cumsum(width) - width, width)
        keep = (on > 0)[place]
        sums = np.bincount((begin[row[place]] + component)[keep], weights=x[keep], minlength=int(dim.sum()))
        n = np.bincount(row[on > 0], minlength=len(tokens))
        mean = sums / np.repeat(np.maximum(n, 1), dim)
        norm = np.sqrt(np.bincount(np.repeat(np.arange(len(dim)), dim), weights=mean * mean, minlength=len(dim)))
        unit = mean / np.repeat(np.where(norm > 0, norm, 1.0), dim)
        yield pa.ListArray.from_arrays(pa.array(np.append(begin, dim.sum()).astype(np.int32)), pa.array(unit))
