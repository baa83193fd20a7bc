"""Katz backoff scoring: Good-Turing discounted n-grams of any order over exactly counted words, with exactly normalised backoff weights.

Tokens are words (A-Z lower-cased) and one end token; texts are padded in front by start marks. Words have p1(w) = (c + 0.1) / (N + 0.1
(V + 1)), counted for every word, which sums to 1 over the V words and one unseen word. From order 2 to `order`,

    p(w | h) = f(h) d(c) c(h, w) / c(h)  if c(h, w) > 0,  else  a(h) p(w | h'),  h' being h without its first word.

d are Katz's discounts of that order for counts up to 5; f(h) is 1, unless discounting leaves nothing for the unseen (then c / (c + 1)) or nothing
is unseen (then c over the discounted mass); a(h) = (1 - seen mass) / (1 - sum of p(w | h') over the seen), so each history's
probabilities sum to 1. A history that was never seen backs off with weight 1.

Stored and evaluated in partitioned tables, of which nothing is cut off, whatever its count:

1. Words are counted and numbered by falling count; a word's number gives its count through a table of one row per distinct count. The `fast` most
   frequent words are known to the tasks, the others are met by a join. The corpus is kept as numbers, in chunks of about
   `chunk_tokens` tokens.
2. For each order, a chunk asks for its distinct n-grams: (history, word, how often in its training texts and, from order 3, their lower-order
   probability), dealt by history to buckets. A bucket adds up the counts, keeps its n-grams as rows of the model, and answers every chunk with the counts,
   and with the history's sums where something is unseen. With the discounts, the chunk evaluates each token from its lower-order
   probability, which recursively came about in the same way.

A chunk asks once for an n-gram however often it occurs, so no n-gram is hot. Histories seen `hot` times or more (N / hot of them at
most, known from the order below) are dealt to several buckets by word, in proportion to their counts, and their sums added up apart. Blobs of sorted, delta-coded and
compressed numbers travel instead of rows.

Up to order 3 n-grams are compared exactly; longer histories by 63-bit hashes, as words are when they are numbered.

Defined cases: a null or empty text is the end token alone; rows with null ids or repeated rows are scored one by one; an empty training set
has N = V = 0 and every token is unseen; a null training flag is false; further columns are ignored. A text is one chunk at most, so it must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch, batches, mix64, runs, slices, word_hashes

TOP_BIT = np.uint64(1 << 63)
END = np.uint64(0x656E64) | TOP_BIT
TOP = 5  # counts above it are not discounted
_ZSTD = pa.Codec("zstd", compression_level=1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts laid end to end, each with its end token; first position of each text, and the total). Their top bit is set."""
    words, at = word_hashes(texts)
    n = len(at) - 1
    out = np.empty(len(words) + n, dtype=np.uint64)
    ends = at[1:] + np.arange(n)
    rest = np.ones(len(out), dtype=bool)
    rest[ends] = False
    out[ends], out[rest] = END, words | TOP_BIT
    return out.view(np.int64), np.append(at[:-1] + np.arange(n), len(out))


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Compressed by planes of bytes; rising numbers as differences."""
    if not len(x):
        return bytes(8)
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return len(x).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(b: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    raw = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), dtype=np.uint8)
    out = np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)
    return np.cumsum(out, dtype=kind) if rising else out


def pack_floats(x: np.ndarray) -> bytes:
    """Few distinct values: a dictionary and places in it."""
    coded = pa.array(x, pa.float64()).dictionary_encode()
    values = pack(coded.dictionary.to_numpy())
    return len(values).to_bytes(8, "little") + values + pack(coded.indices.to_numpy().astype(np.int32))


def unpack_floats(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return unpack(b[8 : 8 + n], np.float64)[unpack(b[8 + n :], np.int32)]


@dataclass
class Words:
    """Totals, the frequent words, and the counts of the others by their numbers. Bounded by `fast` and by the number of distinct counts."""

    hashes: np.ndarray  # of frequent words, sorted
    numbers: np.ndarray  # theirs
    counts: np.ndarray  # of words, by number, as far as they are frequent
    starts: np.ndarray  # first number of each count below
    lower: np.ndarray  # and that count
    total: int
    distinct: int
    texts: int

    @property
    def unknown(self) -> int:
        return self.distinct

    @property
    def start(self) -> int:
        return self.distinct + 1

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; that of the start mark is the number of texts."""
        size = len(self.counts)
        out = np.zeros(len(ids), dtype=np.int64)
        low = ids < size
        out[low] = self.counts[ids[low]]
        if len(self.starts):
            mid = ~low & (ids < self.distinct)
            out[mid] = self.lower[np.searchsorted(self.starts, ids[mid], side="right") - 1]
        out[ids == self.start] = self.texts
        return out

    def p(self, ids: np.ndarray) -> np.ndarray:
        return (self.count(ids) + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of frequent words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int32)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1).astype(np.int32)


@dataclass
class Hot:
    """Histories that are frequent, each dealt to a number of buckets by word instead of to one."""

    keys: np.ndarray  # sorted
    parts: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each history, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


def hot_histories(keys: np.ndarray, counts: np.ndarray, limit: int) -> Hot:
    """Parts in proportion to the counts, so that all of them together are no more than twice N / limit."""
    keys, first = np.unique(keys.astype(np.int64), return_index=True)
    return Hot(keys, 1 + counts[first] // limit)


@dataclass
class Order:
    """One order of the model: discounts, sums of hot histories, and the table of its n-grams (rows of blobs by bucket)."""

    discounts: np.ndarray  # by count, 1 from TOP + 1 on
    hot: Hot
    sums: np.ndarray  # of hot histories: n-grams by count 1 to TOP, counts above TOP added up, lower-order probability of the seen
    table: DataFrame | None = None

    def weights(self, sums: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """f and a of histories with these sums and counts."""
        mass = sums[:, :TOP] @ (self.discounts[1 : TOP + 1] * np.arange(1, TOP + 1)) + sums[:, TOP]
        rest = 1 - sums[:, TOP + 1]
        full = rest < 1e-12
        f = np.where(full, c / np.maximum(mass, 1e-300), np.where(sums[:, :TOP].any(axis=1), 1.0, c / (c + 1)))
        return f, np.where(full, 1.0, np.maximum(1 - f * mass / c, 0) / np.where(full, 1.0, rest))


@dataclass
class Model:
    words: Words
    numbers: DataFrame  # (k, id) of the words that are not frequent
    orders: list[Order]
    buckets: int
    scratch: Scratch


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's discounts from the numbers of n-grams by count; where these don't give 0 < d < 1, (r - 1/2) / r."""
    out = np.ones(TOP + 1)
    cut = (TOP + 1) * n.get(TOP + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, TOP + 1):
        d = -1.0
        if n.get(r) and n.get(r + 1) and cut < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _count_words(df: DataFrame, text: str, most: int = 1 << 21) -> DataFrame:
    """(k, c): words' hashes and counts, added up within each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        held = 0
        for b in it:
            for part in slices(b, text):
                parts.append(np.unique(tokens(part.column(text))[0], return_counts=True))
                held += len(parts[-1][0])
                if held > most:
                    parts[:] = [merged()]
                    held = len(parts[0][0])
                    if held > most // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, parts.pop())], ["k", "c"])
                        held = 0
        if parts:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], ["k", "c"])

    return batches(df.select(text), run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _number_words(df: DataFrame, text: str, scratch: Scratch, fast: int) -> tuple[Words, DataFrame]:
    """Numbers by falling count; frequent words on the driver, the others by (count, hash) with offsets per count."""
    counted = scratch.save(_count_words(df, text), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(END.view(np.int64))
    texts = counted.where(F.col("k") == end).first()
    sizes = counted.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    fits = sizes["c"][sizes["n"].cumsum() <= fast]
    often = (F.col("c") >= int(fits.min() if len(fits) else total + 1)) | (F.col("k") == end)
    top = counted.where(often).toPandas()
    k, c = top["k"].to_numpy(dtype=np.int64), top["c"].to_numpy(dtype=np.int64)
    order = np.lexsort((k, -c))
    k, c = k[order], c[order]
    by = np.argsort(k)
    rest = counted.where(~often).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(max(1, -(-distinct // 500_000)))))
    groups = scratch.save(rest.groupBy("c", "b").agg(F.count("*").alias("n")), "counts")  # at most buckets x the smallest frequent count
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("c"), "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(k)
    groups = groups.select(F.col("c").alias("c2"), F.col("b").alias("b2"), before.alias("first"))
    place = F.row_number().over(Window.partitionBy("c", "b").orderBy("k")) - 1
    numbers = rest.withColumn("place", place).join(groups, (F.col("c") == F.col("c2")) & (F.col("b") == F.col("b2"))).select("k", (F.col("first") + F.col("place")).cast("int").alias("id"))
    numbers = scratch.save(numbers, "numbers")
    if distinct >= (1 << 31) - 2:
        raise ValueError("too many distinct words for numbers of 31 bits")
    less = groups.groupBy("c2").agg(F.min("first").alias("first")).orderBy("first").toPandas()
    scratch.drop(counted)
    words = Words(k[by], by.astype(np.int32), c, less["first"].to_numpy(dtype=np.int64), less["c2"].to_numpy(dtype=np.int64), int(total), int(distinct), int(texts["c"]) if texts else 0)
    return words, numbers


def _code(df: DataFrame, text: str, train: Column, keep: tuple[str, ...], words: Words, numbers: DataFrame, scratch: Scratch, chunk_tokens: int) -> tuple[DataFrame, str, int]:
    """The corpus as word numbers in chunks: (chunk, train, keep columns, ids); the keep columns' schema; number of chunks."""
    kept = [f"_{i}" for i in range(len(keep))]
    given = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, kept, strict=True)], F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("text"))
    fields = "".join(f", {a} {given.schema[a].dataType.simpleString()}" for a in kept)
    known = df.sparkSession.sparkContext.broadcast(words)
    names = ["chunk", "train", *kept, "ids", "rare"]

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, chunk, size = known.value, TaskContext.get().partitionId() << 24, 0
        for b in it:
            for part in slices(b, "text", 1 << 20):
                hashes, at = tokens(part.column("text"))
                ids = w.find(hashes)
                rare = [pack(hashes[lo:hi][ids[lo:hi] < 0]) for lo, hi in pairwise(at.tolist())]
                number = np.full(part.num_rows, chunk, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), part.column("train"), *(part.column(a) for a in kept), pa.array([pack(ids[lo:hi]) for lo, hi in pairwise(at.tolist())]), pa.array(rare)], names)
                size += len(hashes)
                if size >= chunk_tokens:
                    chunk, size = chunk + 1, 0

    coded = scratch.save(batches(given, code, f"chunk long, train boolean{fields}, ids binary, rare binary"), "coded")

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for (chunk,), part in runs(iter([b]), "chunk"):
                k = np.unique(np.concatenate([unpack(x.as_py(), np.int64) for p in part for x in p.column("rare")]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(k)], ["chunk", "k"])

    asked = batches(coded.select("chunk", "rare"), ask, "chunk long, k long").join(numbers, "k")
    chunks = coded.select("chunk").distinct().count()
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    docs = coded.select("chunk", F.lit(1).alias("kind"), none("long", "k"), none("int", "id"), "train", *kept, "ids", "rare")
    found = asked.select("chunk", F.lit(0), "k", "id", none("boolean", "train"), *[none(given.schema[a].dataType, a) for a in kept], none("binary", "ids"), none("binary", "rare"))
    met = docs.union(found).repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk", "kind")

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = known.value
        for _, parts in runs(it, "chunk"):
            t = pa.Table.from_batches(parts).combine_chunks()
            kind = t["kind"].to_numpy()
            first = int(np.searchsorted(kind, 1))
            k, id_ = t["k"][:first].to_numpy(), t["id"][:first].to_numpy()
            k, at = np.unique(k, return_index=True)
            id_ = id_[at]
            for b in t.slice(first).to_batches(max_chunksize=256):
                out = []
                for ids, rare in zip(b.column("ids"), b.column("rare"), strict=True):
                    ids, rare = unpack(ids.as_py(), np.int32), unpack(rare.as_py(), np.int64)
                    if len(rare):
                        ids = ids.copy()
                        got = np.full(len(rare), w.unknown, dtype=np.int32)
                        if len(k):
                            i = np.searchsorted(k, rare)
                            i[i == len(k)] = 0
                            got = np.where(k[i] == rare, id_[i], got)
                        ids[ids < 0] = got
                    out.append(pack(ids))
                yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("train"), *(b.column(a) for a in kept), pa.array(out, pa.binary())], ["chunk", "train", *kept, "ids"])

    corpus = scratch.save(batches(met, settle, f"chunk long, train boolean{fields}, ids binary"), "corpus")
    scratch.drop(coded)
    return corpus, fields, chunks


def extended(order: int, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of the next order's histories, which are this order's n-grams: both numbers up to order 2, hashes beyond."""
    if order == 2:
        return h << 32 | w
    return (mix64(mix64(h.view(np.uint64)) + w.view(np.uint64)) >> np.uint64(1)).view(np.int64)


class Chunk:
    """A chunk's tokens, and their probabilities of the orders settled so far."""

    def __init__(self, words: Words, ids: list[np.ndarray], train: np.ndarray) -> None:
        self.words, sizes = words, np.array([len(x) for x in ids])
        self.ids = np.concatenate(ids).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.train = np.repeat(train, sizes)
        self.counts = words.count(self.ids)  # of the n-gram of the last order that ends at each token
        self.p = words.p(self.ids)
        self.order, self.mark = 1, words.start
        self.history = self.before(self.ids, words.start)  # keys of the next order's histories
        self.rank = self.history  # numbers of the histories, equal where their keys are

    def before(self, values: np.ndarray, first: int) -> np.ndarray:
        """Each token's predecessor's value, or `first` where a text begins."""
        out = np.empty(len(values), dtype=np.int64)
        out[1:] = values[:-1]
        out[self.at[:-1]] = first
        return out

    def distinct(self, hot: Hot, buckets: int) -> None:
        """The next order's n-grams with a seen history, by bucket, history and word."""
        seen = self.before(self.counts, self.words.texts)  # a history's count is that of the n-gram before
        self.where = np.flatnonzero(seen > 0)
        h, w = self.history[self.where], self.ids[self.where]
        grams, first, self.inverse = np.unique(self.rank[self.where] << 32 | w, return_index=True, return_inverse=True)
        self.h, self.w = h[first], grams & 0xFFFFFFFF
        self.low, self.seen = self.p[self.where[first]], seen[self.where[first]]
        self.n = np.bincount(self.inverse, weights=self.train[self.where], minlength=len(grams)).astype(np.int64)
        mixed = mix64(self.h.view(np.uint64))
        at, hit = hot.find(self.h)
        hit = np.flatnonzero(hit)
        mixed[hit] = mix64(mixed[hit] + mix64(self.w[hit].view(np.uint64)) % hot.parts[at[hit]].astype(np.uint64))
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        self.dealt = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.dealt], np.arange(buckets + 1))

    def requests(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places of its n-grams)."""
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield b, self.dealt[self.bounds[b] : self.bounds[b + 1]]

    def settle(self, order: Order, answers: dict[int, tuple[bytes, bytes, bytes]]) -> None:
        """Take the counts and sums of one order from the buckets' answers."""
        c = np.zeros(len(self.h), dtype=np.int64)
        f, a = np.ones(len(self.h)), np.ones(len(self.h))
        for b, at in self.requests():
            counts, odd, sums = answers[b]
            c[at] = unpack(counts, np.uint32)
            odd = unpack(odd, np.int32)
            if len(odd):  # histories with sums, as places among the request's histories
                part = self.h[at]
                rank = np.concatenate([[0], np.cumsum(part[1:] != part[:-1])])
                i = np.minimum(np.searchsorted(odd, rank), len(odd) - 1)
                hit = np.flatnonzero(odd[i] == rank)
                f[at[hit]], a[at[hit]] = order.weights(unpack(sums, np.float64).reshape(-1, TOP + 2)[i[hit]], self.seen[at[hit]])
        i, hit = order.hot.find(self.h)
        if hit.any():
            hit = np.flatnonzero(hit)
            f[hit], a[hit] = order.weights(order.sums[i[hit]], self.seen[hit])
        kept = c * order.discounts[np.where(c <= TOP, c, 0)]
        p = np.where(c > 0, f * kept / self.seen, a * self.low)
        self.counts = np.zeros(len(self.ids), dtype=np.int64)
        self.counts[self.where] = c[self.inverse]
        self.p[self.where] = p[self.inverse]
        self.order += 1
        self.mark = int(extended(self.order, np.array([self.mark]), np.array([self.words.start]))[0])
        self.history = self.before(extended(self.order, self.history, self.ids), self.mark)
        place = np.zeros(len(self.ids), dtype=np.int64)  # a history is the n-gram before, so its place among these numbers it
        place[self.where] = self.inverse
        self.rank = self.before(place, (1 << 31) - 1)


def _chunks(corpus: DataFrame, answers: list[DataFrame], chunks: int, kept: list[str]) -> DataFrame:
    """Documents and answers of each chunk, together and in order: (chunk, kind, bucket, a, b, c, train, keep columns, ids)."""
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    rows = corpus.select("chunk", F.lit(1 << 20).alias("kind"), none("int", "bucket"), *[none("binary", x) for x in "abc"], "train", *kept, "ids")
    for k, t in enumerate(answers):
        rows = rows.union(t.select("chunk", F.lit(k), "bucket", "a", "b", "c", none("boolean", "train"), *[none(corpus.schema[x].dataType, x) for x in kept], none("binary", "ids")))
    return rows.repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk", "kind")


def _settled(parts: list[pa.RecordBatch], words: Words, orders: list[Order], buckets: int) -> tuple[Chunk, pa.Table]:
    """A chunk with the orders that are known, and its documents' rows."""
    t = pa.Table.from_batches(parts)
    kind = t["kind"].to_numpy()
    first = int(np.searchsorted(kind, 1 << 20))
    docs = t.slice(first)
    chunk = Chunk(words, [unpack(x.as_py(), np.int32) for x in docs["ids"]], docs["train"].to_numpy())
    for k, order in enumerate(orders):
        lo, hi = np.searchsorted(kind, [k, k + 1])
        rows = t.slice(lo, hi - lo).select(["bucket", "a", "b", "c"]).to_pydict()
        chunk.distinct(order.hot, buckets)
        chunk.settle(order, {b: x for b, *x in zip(*rows.values(), strict=True)})
    return chunk, docs


_ASKED = "bucket int, chunk long, h binary, w binary, n binary, p binary"
_MET = "kind int, chunk long, bucket int, a binary, b binary, c binary, d binary"
ANSWER, STATS, HOT, OFTEN, GRAMS = range(5)


def _ask(chunks: DataFrame, words, orders: list[Order], hot: Hot, buckets: int) -> DataFrame:  # noqa: ANN001
    """The chunks' requests for the next order."""
    shared = chunks.sparkSession.sparkContext.broadcast([Order(o.discounts, o.hot, o.sums) for o in orders])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), parts in runs(it, "chunk"):
            chunk, _ = _settled(parts, words.value, shared.value, buckets)
            chunk.distinct(hot, buckets)
            for b, at in chunk.requests():
                n = chunk.n[at]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack(chunk.h[at], True), pack(chunk.w[at].astype(np.int32)), pack(n.astype(np.uint32)), pack_floats(chunk.low[at[n > 0]]) if shared.value else None))], ["bucket", "chunk", "h", "w", "n", "p"])

    return batches(chunks, run, _ASKED)


def _meet(asked: DataFrame, words, order: int, hot: Hot, buckets: int, often: int) -> DataFrame:  # noqa: ANN001
    """Buckets add up what chunks ask for, and answer; see the kinds above."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(kind: int, chunk: int, bucket: int, *blobs: bytes) -> pa.RecordBatch:
            cells = [pa.array([kind], pa.int32()), pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in [*blobs, *[None] * (4 - len(blobs))])]
            return pa.RecordBatch.from_arrays(cells, ["kind", "chunk", "bucket", "a", "b", "c", "d"])

        for (bucket,), parts in runs(it, "bucket"):
            t = pa.Table.from_batches(parts)
            chunk = t["chunk"].to_pylist()
            hs, ws, ns = ([unpack(x.as_py(), kind, c == "h") for x in t[c]] for c, kind in (("h", np.int64), ("w", np.int32), ("n", np.uint32)))
            sizes = [len(x) for x in hs]
            h, w, n = np.concatenate(hs), np.concatenate(ws).astype(np.int64), np.concatenate(ns).astype(np.int64)
            del hs, ws, ns
            if order == 2:  # the history's number itself fits
                grams, inverse = np.unique(h << 32 | w, return_inverse=True)
                keys, owner = np.unique(grams >> 32, return_inverse=True)
            else:
                keys, rank = np.unique(h, return_inverse=True)
                grams, inverse = np.unique(rank << 32 | w, return_inverse=True)
                owner = grams >> 32
                del rank
            del h, w
            c = np.bincount(inverse, weights=n, minlength=len(grams)).astype(np.int64)
            if order == 2:
                low = words.value.p(grams & 0xFFFFFFFF)
            else:  # equal wherever it is given
                low = np.zeros(len(grams))
                low[inverse[n > 0]] = np.concatenate([unpack_floats(x.as_py()) for x in t["p"]])
            sums = np.zeros((len(keys), TOP + 2))
            few = c <= TOP
            np.add.at(sums, (owner[few & (c > 0)], c[few & (c > 0)] - 1), 1.0)
            sums[:, TOP] = np.bincount(owner[~few], weights=c[~few], minlength=len(keys))
            sums[:, TOP + 1] = np.bincount(owner, weights=np.where(c > 0, low, 0.0), minlength=len(keys))
            is_hot = hot.find(keys)[1]
            odd = (~sums[:, :TOP].any(axis=1) | (1 - sums[:, TOP + 1] < 1e-12)) & ~is_hot
            at = 0
            for number, size in zip(chunk, sizes, strict=True):
                got = inverse[at : at + size]
                at += size
                if number < 0:  # a stored model's rows
                    continue
                mine = owner[got]
                new = np.concatenate([[True], mine[1:] != mine[:-1]])
                wants = np.zeros(int(new.sum()), dtype=bool)
                wants[np.cumsum(new)[c[got] == 0] - 1] = True
                own = mine[new]
                wants = (wants | odd[own]) & ~is_hot[own]
                yield row(ANSWER, number, bucket, pack(c[got].astype(np.uint32)), pack(np.flatnonzero(wants).astype(np.int32)), pack(sums[own[wants]].reshape(-1)))
            r = np.bincount(c[c <= TOP + 1], minlength=TOP + 2)
            yield row(STATS, -1, bucket, pack(r.astype(np.int64)))
            if is_hot.any():
                yield row(HOT, -1, bucket, pack(keys[is_hot]), pack(sums[is_hot].reshape(-1)))
            high = np.flatnonzero(c >= often)
            if len(high):
                yield row(OFTEN, -1, bucket, pack(keys[owner[high]]), pack(grams[high] & 0xFFFFFFFF), pack(c[high]))
            seen = np.flatnonzero(c)
            if len(seen):
                yield row(GRAMS, -1, bucket, pack(keys[owner[seen]], True), pack((grams[seen] & 0xFFFFFFFF).astype(np.int32)), pack(c[seen].astype(np.uint32)), *([] if order == 2 else [pack_floats(low[seen])]))

    return batches(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, _MET)


def _evaluate(df: DataFrame, text: str, keep: tuple[str, ...], train: Column, order: int, scratch: Scratch, words: Words, numbers: DataFrame, model: Model | None, buckets: int | None, chunk_tokens: int, bucket_grams: int, hot: int) -> tuple[DataFrame, Model]:
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    corpus, fields, chunks = _code(df, text, train, keep, words, numbers, scratch, chunk_tokens)
    kept = [f"_{i}" for i in range(len(keep))]
    buckets = buckets or max(1, -(-max(words.total, chunks * chunk_tokens) // bucket_grams))
    known = spark.sparkContext.broadcast(words)
    orders: list[Order] = []
    answers: list[DataFrame] = []
    mark = np.array([words.start])  # the history at a text's start
    high = np.flatnonzero(words.counts >= hot)
    often = hot_histories(np.append(high, mark), np.append(words.counts[high], words.texts), hot)  # of order 2
    for k in range(2, order + 1):
        old = model.orders[k - 2] if model else None
        if old:
            often = old.hot
        asked = _ask(_chunks(corpus, answers, chunks, kept), known, orders, often, buckets)
        if old:
            asked = asked.union(old.table.select("bucket", F.lit(-1).cast("long"), "a", "b", "c", "d"))
        met = scratch.save(_meet(asked, known, k, often, buckets, hot), f"order{k}")
        jvm.System.gc()  # lets Spark delete the files of shuffles that are done
        table = met.where(F.col("kind") == GRAMS).select("bucket", "a", "b", "c", "d")
        if old:
            orders.append(Order(old.discounts, old.hot, old.sums, old.table))
        else:
            r = sum((unpack(x["a"], np.int64) for x in met.where(F.col("kind") == STATS).select("a").toLocalIterator()), np.zeros(TOP + 2, dtype=np.int64))
            sums = np.zeros((len(often.keys), TOP + 2))
            for x in met.where(F.col("kind") == HOT).select("a", "b").toLocalIterator():
                np.add.at(sums, np.searchsorted(often.keys, unpack(x["a"], np.int64)), unpack(x["b"], np.float64).reshape(-1, TOP + 2))
            orders.append(Order(discounts(dict(enumerate(r.tolist()))), often, sums, table))
            high = [(extended(k, unpack(x["a"], np.int64), unpack(x["b"], np.int64)), unpack(x["c"], np.int64)) for x in met.where(F.col("kind") == OFTEN).select("a", "b", "c").toLocalIterator()]
            mark = extended(k, mark, np.array([words.start]))
            often = hot_histories(np.concatenate([mark, *[h for h, _ in high]]), np.concatenate([[words.texts], *[c for _, c in high]]), hot)
        answers.append(met.where(F.col("kind") == ANSWER).select("chunk", "bucket", "a", "b", "c"))
    shared = spark.sparkContext.broadcast([Order(o.discounts, o.hot, o.sums) for o in orders])

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = known.value
        for _, parts in runs(it, "chunk"):
            chunk, docs = _settled(parts, w, shared.value, buckets)
            doc = np.repeat(np.arange(docs.num_rows), np.diff(chunk.at))
            sums = [np.bincount(doc, weights=x, minlength=docs.num_rows) for x in (np.log10(w.p(chunk.ids)), np.log10(chunk.p))]
            seen = np.bincount(doc, weights=w.count(chunk.ids) > 0, minlength=docs.num_rows).astype(np.int64)
            cells = [docs[a].combine_chunks() for a in kept]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(np.diff(chunk.at)), pa.array(seen), *map(pa.array, sums)], [*kept, "n_tokens", "n_known", "base_score", "score"])

    out = batches(_chunks(corpus, answers, chunks, kept), finish, f"{fields[2:]}{', ' if kept else ''}n_tokens long, n_known long, base_score double, score double")
    out = out.select(*[F.col(a).alias(c) for a, c in zip(kept, keep, strict=True)], "n_tokens", "n_known", "base_score", "score")
    return out, Model(words, numbers, orders, buckets, scratch)


def learn(df: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = (), order: int = 3, fast: int = 1 << 18, chunk_tokens: int = 1 << 20, bucket_grams: int = 1 << 21, hot: int = 1 << 17) -> tuple[DataFrame, Model]:
    """(keep columns, n_tokens, n_known, base_score and score of every row; the model), learned from the rows where `train` holds."""
    scratch = Scratch(df.sparkSession, "katz")
    words, numbers = _number_words(df.where(train), text, scratch, fast)
    return _evaluate(df, text, keep, train, order, scratch, words, numbers, None, None, chunk_tokens, bucket_grams, hot)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = (), chunk_tokens: int = 1 << 20) -> DataFrame:
    """The same columns for other rows, from the model's stored tables."""
    scratch = Scratch(df.sparkSession, "katz-score")
    out, _ = _evaluate(df, text, keep, F.lit(False), len(model.orders) + 1, scratch, model.words, model.numbers, model, model.buckets, chunk_tokens, 1, 1 << 62)
    return out
