"""Exact top-k search by inner product, in buckets of vectors of like length.

Components become whole numbers, floor(scale * x). Vectors are ordered by dimension and length and cut into buckets of at most a few
thousand, which are dealt to stripes; queries come in blocks. A query that already has k results knows the score to reach; divided by its
own length and the bucket's largest, that is the cosine a vector of this bucket needs (local threshold):

* over 1: the bucket is passed over, and so is a stripe whose longest vector is too short for every query of a block;
* near 1: coordinate pruning. Of the query's largest coordinates each bounds the same coordinate of a unit vector within that cosine; ranges
  of the bucket's sorted coordinates are cut with one another;
* else: length pruning. A bucket is ordered by length, so only a prefix of it can reach the score.

Products of what is left are verified as whole numbers: in doubles where these are exact, else in unbounded integers. The scores to start
from are found among each dimension's longest bucket. Tasks return at most k rows per query and stripe, none under its known score; a window
with a group limit merges them.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors meet vectors of their own dimension only,
0 included (score 0); zero vectors score 0 with all; a row is no candidate of itself, but of rows with the same id and content; ties go to
the smaller id, a null id being the last (rows of equal id and score are alike); an empty table gives an empty result; further columns are ignored; a score
that doesn't fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch, batches, slices

#: Vectors and bytes of a bucket, queries of a block.
BUCKET, BUCKET_BYTES, BLOCK = 4096, 1 << 20, 256
#: Stripes of a table: at most this many, so that their table may be broadcast.
MOST_STRIPES = 1 << 14
#: Bytes of longest buckets that may be broadcast.
MOST_HEADS = 1 << 25
#: From this local threshold on coordinates prune, of which so many are looked at.
COORDINATES_FROM, FOCUS = 0.8, 4
_EXACT = float(1 << 52)
_TYPES = [np.dtype("int8"), np.dtype("int16"), np.dtype("int32"), np.dtype("float64")]
_LIKE = "ids binary, none binary, rows binary, lengths binary, kind int, data binary"


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    most = np.abs(values).max(initial=0)
    kind = next(i for i, t in enumerate(_TYPES) if t.kind == "f" or most <= np.iinfo(t).max)
    return kind, values.astype(_TYPES[kind]).tobytes()


def quantise(vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension: (rows, floor(scale * x) as doubles) of the vectors that take part."""
    sizes = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()  # null vectors have no values there
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    x[missing] = np.nan
    start = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        values = x[start[at][:, None] + np.arange(dim)]
        good = np.isfinite(values).all(axis=1)
        yield at[good], np.floor(scale * values[good])


def _vectors(df: DataFrame, vec_id: str, embedding: str, is_query: Column, scale: float) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, "e"):
                for at, values in quantise(part.column("e"), scale):
                    with np.errstate(over="ignore"):
                        lengths = np.sqrt((values * values).sum(axis=1))
                    most = np.abs(values).max(axis=1, initial=0)
                    kinds = np.select([most <= np.iinfo(t).max for t in _TYPES[:-1]], range(len(_TYPES) - 1), len(_TYPES) - 1)
                    for kind in np.unique(kinds).tolist():
                        here = kinds == kind
                        data = np.ascontiguousarray(values[here].astype(_TYPES[kind]))
                        n, dim = data.shape
                        places = (np.arange(n + 1) * dim * data.itemsize).astype(np.int32)
                        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(data)])
                        taken = pa.array(at[here])
                        columns = [part.column(c).take(taken) for c in ("row", "vec_id", "is_query")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, dim), pa.int32()), pa.array(lengths[here]), pa.array(np.full(n, kind), pa.int32()), packed], ["row", "vec_id", "is_query", "dim", "length", "kind", "data"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(f"`{embedding}`").alias("e"))
    return batches(rows, run, "row long, vec_id long, is_query boolean, dim int, length double, kind int, data binary")


def _blocks(most: int, extra: tuple[str, ...] = ()):
    """Consecutive rows of a dimension, packed into one row with their number and their first and last length; further double columns as arrays."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows, ids, dims, lengths, kinds, data, *more = zip(*held, strict=True)
            values = np.stack([np.frombuffer(d, dtype=_TYPES[k]).astype(np.float64) for k, d in zip(kinds, data, strict=True)])
            kind, packed = _pack(values)
            columns = {"dim": pa.array(dims[:1], pa.int32()), "longest": pa.array([max(lengths)], pa.float64()), "first": pa.array([rows[0]], pa.int64())}
            columns |= {"ids": np.array([0 if x is None else x for x in ids], dtype=np.int64), "none": np.array([x is None for x in ids], dtype=bool), "rows": np.array(rows, dtype=np.int64), "lengths": np.array(lengths)}
            columns |= {c: np.array(x) for c, x in zip(extra, more, strict=True)}
            columns = {c: v if isinstance(v, pa.Array) else pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()}
            return pa.RecordBatch.from_pydict(columns | {"kind": pa.array([kind], pa.int32()), "data": pa.array([packed], pa.binary())})

        for batch in it:
            for row in zip(*[batch.column(c).to_pylist() for c in ("row", "vec_id", "dim", "length", "kind", "data", *extra)], strict=True):
                cost = row[2] * 8 + 8
                if held and (row[2] != held[0][2] or len(held) >= most or size + cost > 4 * BUCKET_BYTES):
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += cost
        if held:
            yield done()

    return run, "dim int, longest double, first long, ids binary, none binary, rows binary, lengths binary" + "".join(f", {c} binary" for c in extra) + ", kind int, data binary"


class Vectors:
    """A bucket or a block of queries, unpacked."""

    def __init__(self, row: dict) -> None:
        self.ids, self.rows = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "rows"))
        self.none = np.frombuffer(row["none"], dtype=bool)
        self.lengths = np.frombuffer(row["lengths"])
        self.values = np.frombuffer(row["data"], dtype=_TYPES[row["kind"]]).astype(np.float64).reshape(len(self.ids), row["dim"])
        self.longest = row["longest"]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors' f-th coordinates in order, and whose they are."""
        if f not in self.sorted:
            unit = self.values[:, f] / np.where(self.lengths > 0, self.lengths, 1.0)
            order = np.argsort(unit, kind="stable")
            self.sorted[f] = unit[order], order
        return self.sorted[f]

    def within(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Places of the vectors that the largest coordinates of a unit vector leave within the cosine."""
        turn = np.arccos(min(1.0, cosine)) + 1e-7
        left: np.ndarray | None = None
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            angle = float(np.arccos(np.clip(unit[f], -1.0, 1.0)))
            values, order = self.coordinate(f)
            lo, hi = np.searchsorted(values, [np.cos(min(np.pi, angle + turn)) - 1e-9, np.cos(max(0.0, angle - turn)) + 1e-9], side="left")
            hit = order[lo:hi]
            left = hit if left is None else np.intersect1d(left, hit, assume_unique=True)
            if not len(left):
                break
        return np.arange(len(self.ids)) if left is None else left


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole-number vectors; unbounded integers where doubles could round."""
    if exact:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)


class Best:
    """The k best results of each query of a block so far."""

    def __init__(self, queries: Vectors, k: int, floor: np.ndarray) -> None:
        self.queries, self.k, self.floor = queries, k, floor.astype(object)
        self.reach = floor.copy()  # doubles, never above the exact floor
        self.held = [np.zeros(0, dtype=t) for t in (np.int64, object, bool, np.int64)]  # query, score, id is null, id

    def add(self, query: np.ndarray, score: np.ndarray, bucket: Vectors, place: np.ndarray) -> None:
        other = bucket.rows[place] != self.queries.rows[query]
        query, score, place = query[other], score[other], place[other]
        if not len(query):
            return
        q, s, n, i = (np.concatenate([a, b]) for a, b in zip(self.held, (query, score.astype(object) if score.dtype == object else score.astype(np.int64).astype(object), bucket.none[place], bucket.ids[place]), strict=True))
        if all(-(1 << 62) < x < 1 << 62 for x in (s.min(), s.max())):
            order = np.lexsort((i, n, -s.astype(np.int64), q))
        else:
            order = np.array(sorted(range(len(q)), key=lambda x: (q[x], -s[x], n[x], i[x])), dtype=np.int64)
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order], side="left")
        self.held = [x[order[rank < self.k]] for x in (q, s, n, i)]
        full = order[rank == self.k - 1]
        for where, x in zip(q[full].tolist(), s[full].tolist(), strict=True):
            if x > self.floor[where]:
                self.floor[where] = x
                self.reach[where] = np.nextafter(float(x), -np.inf) if abs(x) >= 1 << 53 else float(x)


def search(queries: Vectors, buckets: list[Vectors], k: int, floor: np.ndarray) -> Best:
    """Buckets by falling length against a block of queries, with the scores to reach."""
    best = Best(queries, k, floor)
    size = queries.lengths * (1 + 1e-9)
    for bucket in buckets:
        longest = bucket.longest * (1 + 1e-9)
        known = best.reach > 0  # other scores prune nothing
        live = ~known | (size * longest >= best.reach)
        if not live.any():
            continue
        exact = bool(size.max(initial=0.0) * longest < _EXACT)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(known & live, best.reach / (size * longest), 0.0)
        narrow = np.flatnonzero(live & (cosine >= COORDINATES_FROM))
        for q in narrow.tolist():
            place = bucket.within(queries.values[q] / queries.lengths[q], float(cosine[q]))
            if len(place):
                score = products(queries.values[q : q + 1], bucket.values[place], exact)[0]
                good = score >= best.floor[q]
                best.add(np.full(int(good.sum()), q), score[good], bucket, place[good])
        wide = np.flatnonzero(live & (cosine < COORDINATES_FROM))
        if not len(wide):
            continue
        # bucket.lengths falls: the prefix that the least demanding query of the block can use
        need = np.where(known[wide], best.reach[wide] / np.maximum(size[wide], 1e-300), 0.0).min()
        m = int(np.searchsorted(-bucket.lengths * (1 + 1e-9), -need, side="right"))
        if not m:
            continue
        scores = products(queries.values[wide], bucket.values[:m], exact)
        low = best.reach[wide] if exact else best.floor[wide]
        if exact and m > k + 1:  # one of them may be the query itself
            low = np.maximum(low, np.partition(scores, m - k - 1, axis=1)[:, m - k - 1])
        at, place = np.nonzero(scores >= low[:, None])
        best.add(wide[at], scores[at, place], bucket, place)
    return best


def _results(best: Best) -> pa.RecordBatch:
    q, s, n, i = best.held
    return pa.RecordBatch.from_arrays([pa.array(best.queries.rows[q]), pa.array(best.queries.ids[q]), pa.array(i, mask=n.astype(bool)), pa.array(s.tolist(), pa.int64())], ["row", "query_id", "vec_id", "score"])


_FOUND = "row long, query_id long, vec_id long, score long"


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding", stripe_bytes: int = 1 << 23) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best other rows of each query row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(_vectors(df, vec_id, embedding, is_query, scale), "vectors")
    count, queries, size = rows.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.sum(F.col("dim") + 64), F.lit(0))).first()
    stripes = max(1, min(MOST_STRIPES, max(-(-size // stripe_bytes), min(spark.sparkContext.defaultParallelism, -(-count // BUCKET)))))

    # buckets by falling length; rows of equal length are dealt by their number
    pack, schema = _blocks(BUCKET)
    ordered = rows.drop("is_query").repartitionByRange(stripes, "dim", F.desc("length"), "row").sortWithinPartitions("dim", F.desc("length"), "row")
    buckets = scratch.save(batches(ordered, pack, schema).withColumn("stripe", F.spark_partition_id()), "buckets")

    # the score to start from, found in the longest bucket of each dimension
    pack, schema = _blocks(BLOCK)
    parts = max(1, min(queries // BLOCK + 1, 4 * spark.sparkContext.defaultParallelism))
    asked = batches(rows.where("is_query").drop("is_query").repartitionByRange(parts, "dim", "row").sortWithinPartitions("dim", "row"), pack, schema)
    heads = buckets.groupBy("dim").agg(F.max_by(F.struct("longest", "first", *[c.split()[0] for c in _LIKE.split(", ")]), F.struct("longest", "first")).alias("head"))
    fits = (buckets.groupBy("dim").agg(F.max(F.octet_length("data") + 25 * F.octet_length("none")).alias("b")).agg(F.sum("b")).first()[0] or 0) <= MOST_HEADS

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                block, head = Vectors(row), Vectors(row["head"] | {"dim": row["dim"]})
                floor = search(block, [head], k, np.full(len(block.ids), -np.inf)).reach
                yield pa.RecordBatch.from_pydict({"row": pa.array(block.rows), "floor": pa.array(floor)})

    with_floor = rows.where("is_query").drop("is_query")
    if fits:
        floors = scratch.save(batches(asked.join(F.broadcast(heads), "dim"), probe, "row long, floor double"), "floors")
        with_floor = with_floor.join(floors, "row")
    else:
        with_floor = with_floor.withColumn("floor", F.lit(float("-inf")))
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("length")).otherwise(0.0)
    pack, schema = _blocks(BLOCK, ("floor",))
    blocks = batches(with_floor.withColumn("need", need).repartitionByRange(parts, "dim", "need", "row").sortWithinPartitions("dim", "need", "row"), pack, schema)

    # a block goes to the stripes that hold a vector long enough for it; _least bounds what its least demanding query needs
    def with_least(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            least = []
            for lengths, floors in zip(batch.column("lengths").to_pylist(), batch.column("floor").to_pylist(), strict=True):
                f, n = np.frombuffer(floors), np.frombuffer(lengths)
                least.append(float(np.where(f > 0, f / np.maximum(n * (1 + 1e-9), 1e-300), 0.0).min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], [*batch.schema.names, "_least"])

    blocks = scratch.save(batches(blocks, with_least, f"{schema}, _least double"), "queries")
    told = buckets.groupBy("stripe", "dim").agg(F.max("longest").alias("_top"))
    dims = told.count() <= 2 * MOST_STRIPES  # a stripe holds several dimensions only where these are small
    sent = blocks.join(F.broadcast(told) if dims else told, "dim").where(F.col("_top") * (1 + 1e-9) >= F.col("_least")).drop("_top", "_least")
    both = buckets.withColumns({"floor": F.lit(None).cast("binary"), "asks": F.lit(0)}).unionByName(sent.withColumn("asks", F.lit(1)))
    both = both.repartitionByRange(stripes, "stripe").sortWithinPartitions("stripe", "asks", F.desc("longest"), "first")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, held = None, {}
        for batch in it:
            for row in batch.to_pylist():
                if row["stripe"] != stripe:
                    stripe, held = row["stripe"], {}
                if not row["asks"]:
                    held.setdefault(row["dim"], []).append(Vectors(row))
                    continue
                yield _results(search(Vectors(row), held.get(row["dim"], []), k, np.frombuffer(row["floor"])))

    found = batches(both, meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    out = scratch.save(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best")
    scratch.keep(out)
    return out
