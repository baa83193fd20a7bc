"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space as the contracts define it: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarnfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where


_OWNER: ContextVar[list[Scratch] | None] = ContextVar("scratch_owner", default=None)


@contextmanager
def owned() -> Iterator[list[Scratch]]:
    """The scratch folders that this block's own thread makes, so that who has saved a result can clear what it came from."""
    made: list[Scratch] = []
    before = _OWNER.set(made)
    try:
        yield made
    finally:
        _OWNER.reset(before)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tarnfold-{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []
        if (owner := _OWNER.get()) is not None:
            owner.append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df as Parquet and read it back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarnfold_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in saved:
            self._delete(df._tarnfold_path)

    def keep(self, *saved: DataFrame) -> None:
        """Delete all tables but these."""
        wanted = {df._tarnfold_path for df in saved}
        for path in [p for p in self.paths if p not in wanted]:
            self._delete(path)

    def clear(self) -> None:
        self.keep()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        if path in self.paths:
            self.paths.remove(path)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give a worker's freed memory back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers release their memory when a task ends."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(it)
        finally:
            release()

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """(keep columns and the text, the text's name there): a text that is kept anyway goes to Python once."""
    if text in keep:
        return df.select(*[F.col(f"`{c}`") for c in keep]), text
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")), "_text"


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of about `limit` bytes of a text, binary or 4-byte list column, so that temporaries stay small."""
    values = batch.column(column)
    lengths = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
    lengths = lengths.fill_null(0).to_numpy(zero_copy_only=False) * (4 if pa.types.is_list(values.type) else 1)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def runs(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, its rows) of consecutive rows whose columns agree, across batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in it:
        values = [b.column(c).to_numpy() for c in columns]
        new = np.zeros(max(0, b.num_rows - 1), dtype=bool)
        for v in values:
            new |= v[1:] != v[:-1]
        for lo, hi in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]):
            if hi == lo:
                continue
            here = tuple(v[lo] for v in values)
            if held and here != key:
                yield key, held
                held = []
            key = here
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, held


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n; kept and grown as needed."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 1 << 64))
                m = min(done, size - done)
                out[done : done + m] = out[:m] * step
                done += m
            _POWERS[key] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words before each text): words are runs of non-space bytes, A-Z lower-cased.

    One vectorised pass over the column's UTF-8 buffer; null texts have no words. The second array has one more
    entry than there are texts.
    """
    texts = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo, hi = int(offsets[0]) if len(offsets) else 0, int(offsets[-1]) if len(offsets) else 0
    offsets = offsets - lo
    n = hi - lo
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi]
    word = ~_SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up, out=total[1:])
    hashes = mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return hashes, np.searchsorted(start, offsets)
