"""Samplers in hash order: quotas, strata, ratios, epochs and mixtures. All are reproducible and mirrored in plain SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators.curate import EDGE, first_n, hash_order, hash_uniform
from tarnfold.sources.files import scratch

#: Buckets up to this number are broadcast with their quotas; hexadecimal digits that are counted at once.
MOST_BUCKETS, DIGITS = 100_000, 3


def take(df: DataFrame, n: int, seed: int | str, *ids: str) -> DataFrame:
    """n rows without replacement, by hash order."""
    certain, edge = first_n(df.withColumn("_h", hash_order(seed, *[F.col(c) for c in ids])), n, "_h", *ids)
    return certain.union(edge).drop("_h")


def take_per(df: DataFrame, n: int, seed: int | str, strata: list[str], *ids: str) -> DataFrame:
    """n rows of each stratum by hash order; a constant limit, which Spark applies within each task first."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, *[F.col(c) for c in ids]), *ids)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def bernoulli(df: DataFrame, p: float, seed: int | str, *ids: str) -> DataFrame:
    return df.where(hash_uniform(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])) < p)


def ratios(raw: dict[str, float]) -> dict[str, float]:
    """Normalised; negatives count as 0; an error if nothing is left."""
    live = {k: max(0.0, v) for k, v in raw.items()}
    total = sum(live.values())
    if total <= 0:
        raise ValueError("ratios sum to 0")
    return {k: v / total for k, v in live.items()}


def largest_remainder(shares: DataFrame, total: int, name: str, share: str, stable: bool = False) -> DataFrame:
    """Adds quota: floor(total * share), and one more for the largest fractions until the total is met.

    Ties go to the larger exact share, then the later name; with `stable`, to the earlier name. One row per bucket.
    """
    exact = F.round(F.col(share) * total, 9)
    base = F.floor(exact)
    order = [F.desc("_frac"), F.asc(name)] if stable else [F.desc("_frac"), F.desc("_exact"), F.desc(name)]
    t = shares.withColumn("_exact", exact).withColumn("_base", base).withColumn("_frac", F.round(exact - base, 9))
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy(F.lit(1)))
    return t.withColumn("_left", left).withColumn("quota", (F.col("_base") + (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) <= F.col("_left")).cast("int")).cast("long")).drop("_exact", "_base", "_frac", "_left")


def chosen_per(df: DataFrame, quotas: DataFrame, bucket: str, h: str, *ties: str) -> DataFrame:
    """Adds _chosen: whether a row is among its bucket's first `quota` by a hexadecimal hash column, for all buckets at once.

    Where each bucket's order is cut is found by counting leading digits of the hash, 4096 values at a time, in the buckets that are still open,
    until few enough rows share the digits; only those are ordered. So no task holds a bucket, however many rows it has. Rows of buckets
    without a quota aren't chosen.
    """
    n = F.greatest(F.coalesce("quota", F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("_n")
    cuts = quotas.select(F.col(bucket), n, F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_before"), F.lit(None).cast("long").alias("_size"))
    few = cuts.count() <= MOST_BUCKETS
    with_cuts = lambda t, c: t.join(F.broadcast(c) if few else c, bucket)
    for at in range(0, 60, DIGITS):
        inside = with_cuts(df.select(bucket, h), cuts.where((F.col("_n") > 0) & (F.col("_size").isNull() | (F.col("_size") > EDGE)))).where(F.col(h).startswith(F.col("_prefix")))
        counts = inside.groupBy(bucket, "_n", "_prefix", "_before", F.substring(h, at + 1, DIGITS).alias("_d")).agg(F.count("*").alias("_c"))
        so_far = F.col("_before") + F.sum("_c").over(Window.partitionBy(bucket).orderBy("_d"))  # at most 4096 rows of a bucket
        cut = counts.withColumn("_to", so_far).where((F.col("_to") >= F.col("_n")) & (F.col("_to") - F.col("_c") < F.col("_n")))
        found = cut.select(bucket, F.concat("_prefix", "_d").alias("_p"), (F.col("_to") - F.col("_c")).alias("_b"), F.col("_c").alias("_s"))
        # a bucket in which nothing was cut has fewer rows than its quota: all are chosen, as beyond the last digit
        new = cuts.join(found, bucket, "left").select(
            bucket,
            "_n",
            F.when(F.col("_p").isNotNull(), F.col("_p")).when(F.col("_size").isNull() & (F.col("_n") > 0), F.lit("g")).otherwise(F.col("_prefix")).alias("_prefix"),
            F.coalesce("_b", "_before").alias("_before"),
            F.coalesce("_s", "_size", F.lit(0)).cast("long").alias("_size"),
        )
        path = scratch(df.sparkSession, "cuts")
        new.write.parquet(path)
        cuts = df.sparkSession.read.parquet(path)
        if (cuts.agg(F.max("_size")).first()[0] or 0) <= EDGE:
            break
    marked = df.join(F.broadcast(cuts) if few else cuts, bucket, "left")
    edge = (F.col("_n") > 0) & (F.length("_prefix") > 0) & F.col(h).startswith(F.col("_prefix"))
    plain = marked.where(~F.coalesce(edge, F.lit(False))).withColumn("_chosen", F.coalesce((F.col("_n") > 0) & (F.col(h) < F.col("_prefix")), F.lit(False)))
    last = marked.where(edge).withColumn("_chosen", F.row_number().over(Window.partitionBy(bucket).orderBy(h, *ties)) <= F.col("_n") - F.col("_before"))
    return plain.unionByName(last).drop("_n", "_prefix", "_before", "_size")


def stratified(df: DataFrame, quotas: DataFrame, bucket: str, total: int, seed: int | str, ident: str) -> DataFrame:
    """Each bucket's quota by hash order; what is missing is filled from the rest, in hash order."""
    marked = chosen_per(df.withColumn("_h", hash_order(seed, F.col(ident))), quotas, bucket, "_h", ident)
    first, others = marked.where("_chosen"), marked.where("not _chosen")
    certain, edge = first_n(others, total - first.count(), "_h", ident)
    return first.withColumn("via", F.lit("quota")).union(certain.union(edge).withColumn("via", F.lit("backfill"))).drop("_h", "_chosen")


def rebalance(a: int, b: int, share_of_a: float) -> tuple[int, int]:
    """The most rows of two pools that keep a : b at share : 1 - share."""
    if share_of_a <= 0:
        return 0, b
    if share_of_a >= 1:
        return a, 0
    total = min(a / share_of_a, b / (1 - share_of_a))
    return min(a, round(total * share_of_a)), min(b, round(total * (1 - share_of_a)))


def copies(df: DataFrame, ident: list[str], near: tuple[str, ...] = ()) -> DataFrame:
    """Adds _copies, how many rows have the same identity, and _copy, which of them a row is. `near`: columns that these rows share too; rows that lie by them aren't dealt anew."""
    w = Window.partitionBy(*near, *ident)
    return df.withColumns({"_copies": F.count(F.lit(1)).over(w), "_copy": F.row_number().over(w.orderBy(*ident)) - 1})


def oversample(df: DataFrame, n: int, seed: int | str, ident: str, rows: int | None = None) -> DataFrame:
    """Reshuffled whole passes until n rows: adds pass and instance. Passes are known from one count."""
    size = df.count() if rows is None else rows
    return passes(copies(df, [ident]), n, seed, F.col(ident), size, ident)


def passes(df: DataFrame, n: int, seed: int | str, ident: Column, size: int, *ties: str) -> DataFrame:
    """`oversample` of `size` rows whose copies are numbered. A pass takes each copy once, its last part the first ones, so instances follow and no row of a pass is dealt."""
    if not size or n <= 0:
        return df.drop("_copies", "_copy").withColumns({"pass": F.lit(0), "instance": F.lit(0).cast("long")}).limit(0)
    whole = math.ceil(n / size)
    last = df.withColumns({"pass": F.lit(whole - 1), "_h": hash_order(seed, F.lit(whole - 1), ident)})
    certain, edge = first_n(last, n - (whole - 1) * size, "_h", *ties, "_copy")
    out = certain.union(edge).drop("_h")
    if whole > 1:
        out = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(whole - 2)))).union(out)
    return out.withColumn("instance", (F.col("pass") * F.col("_copies") + F.col("_copy")).cast("long")).drop("_copies", "_copy")


def mixture_size(counts: dict[str, int], shares: dict[str, float]) -> int:
    """The smallest total at which every part's whole pool is used."""
    return math.ceil(max(n / shares[k] for k, n in counts.items() if shares.get(k, 0) > 0))


def focus(id_: str, value: Column, group: list[str]) -> tuple[Column, list[str]]:
    """Aggregate: the ids of the lowest, highest and middle rows, distinct, in that order."""
    s = F.array_sort(F.collect_list(F.struct(value.alias("v"), F.col(id_).alias("i"))))
    pick = F.array_distinct(F.array(s[0]["i"], F.element_at(s, -1)["i"], s[F.floor(F.size(s) / 2).cast("int")]["i"]))
    return pick, group
