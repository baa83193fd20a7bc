"""Embedding near-duplicates by a pivot-permutation index.

1. Pivots are a bounded sample of the vectors of each length (those with the lowest hashes): about 12 n^(1/3) of n, so that the candidates grow
   in proportion to the vectors. A vector is described by its `near` nearest pivots in order of distance. Vectors with the same
   components are one class, compared once and counted with its size.
2. Inverted lists: a vector is listed under every combination of `shared` of its pivots, within its label and length. Two vectors share a list
   exactly when they share at least that many pivots, so the lists are the shared-pivot counts of interest, already met. A list with
   one member leads nowhere and is dropped before any vector moves.
3. Lists are cut into blocks of at most `block` vectors by a hash; blocks meet pairwise. A task computes one pair of blocks' cosines
   in double precision; a pair of vectors counts only under the smallest combination it shares, so nothing counts twice. It returns the
   links' number for each vector, and a spanning forest of the links instead of the links.

Classes of more than a thousandth of the rows, a thousand at most, are broadcast to find their rows' class; the others are joined by their components.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null label, nor vectors of different lengths.
Recall against brute force is measured in the tests. Defined cases: repeated rows with one id count as further vectors of that id and
give a row each; ties between pivots are broken by the pivot's number; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch, batches
from tarnfold.llm.components import components

PIVOT_BITS = 20


def usable(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v array<double> of the vectors that can link."""
    given = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def fit_pivots(vectors: DataFrame, density: float) -> dict[int, np.ndarray]:
    """By length, about density x n^(1/3) unit vectors of n: of four times as many with the lowest hashes, those apart from the ones before
    (cosine under 0.7), as pivots that are copies of each other would be ordered by chance."""
    sizes = {r["n"]: r["count"] for r in vectors.groupBy(F.size("v").alias("n")).count().collect()}
    want = {n: max(1, min(count, math.ceil(density * count ** (1 / 3)))) for n, count in sizes.items()}
    if not want:
        return {}
    if max(want.values()) >= 1 << PIVOT_BITS:
        raise ValueError("too many pivots for their numbers; lower density")
    # by hash below a threshold instead of by rank, so that no task sees all vectors of a length
    low = F.lit(-1.0)
    for n, count in sizes.items():
        low = F.when(F.size("v") == n, min(1.0, 12 * want[n] / count + 64 / count)).otherwise(low)
    rows = vectors.select(F.xxhash64("v").alias("h"), "v").where(F.col("h") / float(1 << 64) + 0.5 <= low).distinct().collect()
    out: dict[int, list[np.ndarray]] = {}
    seen: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["v"])):
        n = len(r["v"])
        seen[n] = seen.get(n, 0) + 1
        mine = out.setdefault(n, [])
        v = unit(np.array([r["v"]]))[0]
        if len(mine) < want[n] and seen[n] <= 4 * want[n] and not (mine and (np.array(mine) @ v >= 0.7).any()):
            mine.append(v)
    return {n: np.array(v) for n, v in out.items()}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], near: int, shared: int) -> DataFrame:
    """Adds `perm` array<int>, the numbers of the nearest pivots, nearest first, and `keys` array<long>, the combinations of `shared` of them."""
    known = vectors.sparkSession.sparkContext.broadcast(pivots)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                rows = part.column("v").to_pylist()
                perms, keys = [None] * len(rows), [None] * len(rows)
                lengths = np.array([len(v) for v in rows])
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    p = known.value[n]
                    s = unit(np.array([rows[i] for i in at])) @ p.T
                    nearest = np.argsort(-s, axis=1, kind="stable")[:, :near]
                    combined = np.array([_key(c) for c in _combinations(np.sort(nearest, axis=1).astype(np.int64), min(shared, len(p)))]).T
                    for i, o, k in zip(at.tolist(), nearest.tolist(), combined.tolist(), strict=True):
                        perms[i], keys[i] = o, k
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(perms, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], [*part.schema.names, "perm", "keys"])

    return batches(vectors, run, f"{fields}perm array<int>, keys array<long>")


def _combinations(numbers: np.ndarray, shared: int) -> Iterator[list[np.ndarray]]:
    for c in combinations(range(numbers.shape[1]), shared):
        yield [numbers[:, i] for i in c]


def _key(numbers: list[np.ndarray]) -> np.ndarray:
    """Rising pivot numbers as one; the number of pivots cannot be told from it, but is the same for all vectors of a length."""
    out = numbers[0]
    for n in numbers[1:]:
        out = out << PIVOT_BITS | n
    return out


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on integers."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, density: float = 12.0, near: int = 7, shared: int = 3, block: int = 512) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept. `shared` is 3 at most."""
    if not 1 <= shared <= 3:
        raise ValueError("shared is 1 to 3")
    spark = df.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = scratch.save(usable(df, vec_id, vector, label), "vectors")
    points = fit_pivots(rows, density)
    classes = scratch.save(rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    lists = classes.select("rep", F.concat_ws("/", F.size("v"), F.col("label").cast("string")).alias("label"), "v", "copies")
    seen = scratch.save(describe(lists, points, near, shared), "index")

    listed = seen.select("rep", "label", F.explode("keys").alias("key"))
    sizes = listed.groupBy("label", "key").agg(F.count("*").alias("size")).where("size > 1")
    posts = listed.join(sizes, ["label", "key"]).select("rep", "label", "key", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    posts = posts.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # Each member goes to the meetings (p, q), p <= q, that its block takes part in.
    meets = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("rep").alias("r2"), F.col("label").alias("l2"), "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")
    full = meets.join(seen, (F.col("l2") == F.col("label")) & (F.col("r2") == F.col("rep"))).select("l2", "key", "p", "q", "part", "rep", "v", "copies", "perm")
    dealt = full.withColumn("meeting", F.xxhash64("l2", "key", "p", "q")).repartition("meeting").sortWithinPartitions("meeting", "l2", "key", "p", "q")
    dealt = dealt.select("meeting", "key", "p", "q", "part", "rep", "copies", "perm", "v")

    def meet(x: np.ndarray, key: int, p: int, q: int, part: np.ndarray, rep: np.ndarray, copies: np.ndarray, perm: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(links of each vector, forest) within one meeting of two blocks."""
        last = key & ((1 << PIVOT_BITS) - 1)
        low = np.zeros((len(x), last + 1), dtype=np.float32)
        row, col = np.nonzero(perm <= last)
        low[row, perm[row, col]] = 1
        a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
        # both share the key; it is their smallest combination if no further pivot up to its last one is shared
        i, j = np.nonzero((x[a] @ x[b].T >= least - 1e-9) & (low[a] @ low[b].T == min(shared, perm.shape[1])))
        i, j = a[i], b[j]
        if p == q:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= least
        i, j = i[exact], j[exact]
        n = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
        return n.astype(np.int64), _forest(rep[i], rep[j])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, key, p, q, part, rep, copies = (t[c].to_numpy() for c in ("meeting", "key", "p", "q", "part", "rep", "copies"))
            (perm, perm_at), (v, v_at) = ((a.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(a.value_lengths().to_numpy()))) for a in (t[c].combine_chunks() for c in ("perm", "v")))
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]]))
            out: list[list] = [[], [], [], []]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x, numbers = (f[at[lo] : at[hi]].reshape(hi - lo, -1) for f, at in ((v, v_at), (perm, perm_at)))
                n, edges = meet(unit(x), int(key[lo]), p[lo], q[lo], part[lo:hi], rep[lo:hi], copies[lo:hi], numbers)
                some = np.flatnonzero(n)
                out[0] += rep[lo:hi][some].tolist() + [e[0] for e in edges]
                out[1] += [-1] * len(some) + [e[1] for e in edges]
                out[2] += n[some].tolist() + [0] * len(edges)
                out[3] += [False] * len(some) + [True] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], ["a", "b", "links", "edge"])

        for b in it:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                ids = part.column("meeting").to_numpy()
                new = np.flatnonzero(ids[1:] != ids[:-1])
                first = part.column("meeting")[0].as_py()
                if held and held[-1].column("meeting")[-1].as_py() != first:
                    yield close(pa.Table.from_batches(held))
                    held = []
                if len(new):  # all meetings but the last have ended
                    end = int(new[-1]) + 1
                    yield close(pa.Table.from_batches([*held, part.slice(0, end)]))
                    held, part = [], part.slice(end)
                held.append(part)
        if held:
            yield close(pa.Table.from_batches(held))

    found = scratch.save(batches(dealt, run, "a long, b long, links long, edge boolean"), "links")
    counts = found.where("not edge").groupBy("a").agg(F.sum("links").alias("links"))
    classed = classes.join(counts, F.col("rep") == F.col("a"), "left").select("label", "v", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "copies")
    classed = scratch.save(classed, "classed")
    large = F.col("copies") > max(1000, rows.count() // 1000)  # a thousand classes at most, whose rows would meet in one task
    named = [F.col("label").alias("l"), F.col("v").alias("w"), "rep", "links"]
    own = rows.select(F.col("vec_id").alias("id"), "label", "v").join(F.broadcast(classed.where(large).select(*named)), (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left").drop("l", "w")
    rest = own.where("rep is null").select("id", "label", "v").join(classed.where(~large).select("label", "v", "rep", "links"), ["label", "v"]).select("id", "rep", "links")
    own = scratch.save(own.where("rep is not null").select("id", "rep", "links").union(rest), "counts")
    whole = components(found.where("edge").select("a", "b").union(own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), scratch)
    whole = own.groupBy("id").agg(F.max("links").alias("links")).join(whole, F.col("id") == F.col("node"), "left").select("id", "links", F.coalesce("component", "id").alias("component"))
    whole = scratch.save(whole, "components")
    scratch.keep(whole)
    ids = df.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = ids.join(whole, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
