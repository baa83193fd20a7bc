"""Typed coercions of loosely typed fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = ("", "none", "nan", "null")


def to_double(c: Column) -> Column:
    """A number or null; NaN and infinities pass."""
    return F.trim(c.cast("string")).try_cast("double")


def finite_double(c: Column, default: float | None = None) -> Column:
    x = to_double(c)
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(default).cast("double"))


def score_0_to_4(c: Column) -> Column:
    """Rounded half to even, bad values 0, clamped to 0..4."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.bround(finite_double(c, 0.0)).cast("int")))


def unit_interval(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite_double(c, 0.0)))


def truthy(c: Column) -> Column:
    """Booleans, numbers other than 0, and the texts 1, true, yes."""
    s = F.lower(F.trim(c.cast("string")))
    return F.coalesce(s.isin("1", "true", "yes") | (to_double(c) != 0), F.lit(False))


def clean(c: Column) -> Column:
    """Trimmed; null and the texts none, nan, null become empty."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(*NOTHING), "").otherwise(s)


def first_present(*cols: Column) -> Column:
    """The first value that is not empty once cleaned."""
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols])


def bucket(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown"))


def solve_bucket(rate: Column, easy: float = 0.7, medium: float = 0.2, hard: float = 0.02) -> Column:
    """Difficulty by solve rate; null is unknown, and NaN, comparing false everywhere, is too_hard."""
    ok = ~F.isnan(rate)
    return F.when(rate.isNull(), "unknown").when(ok & (rate >= easy), "easy").when(ok & (rate >= medium), "medium").when(ok & (rate >= hard), "hard_but_learnable").otherwise("too_hard")
