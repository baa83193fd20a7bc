"""Source divergence audit: how far each source of a language is from the other sources, and by which terms.

Terms are runs of ASCII letters and of characters from U+0080 on; only A-Z are lower-cased. A language keeps the terms that stand in at
least `least_docs` of its documents. Document frequencies are first counted in a count-min sketch: each task adds its own, the merged
cells never underestimate, so a (language, term) with a cell under `least_docs` can't be kept and is dropped before anything is shuffled
by term. What survives is counted exactly. A pair of sources shares few of the terms, so its sum over all kept terms is put together from
three sparse parts: terms that both use (a join by term), terms that one of them uses (a histogram of its counts against the other's value for
count 0), and terms that neither uses (a number times a constant).

All arithmetic is in whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f(p, q) = floor((p - q)^2 / (p + q)).

Defined cases: null text, language or source count as empty text; a group without terms has p from count 0; a language without kept terms
gives 0 for each pair and no terms; repeated rows are documents of their own; an empty table gives an empty result; further
columns are ignored; texts of any length are read whole, in slices of 2 MB or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import _LOWER, Scratch, batches, mix64, slices, word_hashes

_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
#: Cells of a sketch that travel together.
CHUNK = 1 << 16
#: Rows of the sketch.
DEPTH = 3
#: Groups (language, source) up to this number are broadcast; beyond it they meet in salted joins.
MOST_BROADCAST = 100_000
SALTS = 32


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(each term's place in the dictionary, the dictionary, terms before each text and in all)."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    offsets, n = offsets - lo, hi - lo
    if n == 0:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.string()), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi]]
    word = _TERM[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends[:-1] &= ~word[1:] | first[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(stop - start, out=places[1:])
    found = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(places), pa.py_buffer(raw[word])]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary, np.searchsorted(start, offsets)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Each key's cell in each row of the sketch, counted through all rows."""
    return [(mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(DEPTH)]


def _counted(batch: pa.RecordBatch, by_source: bool) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For each slice: its groups, and for each (group, term) of it the group, the term, its occurrences and its documents; the dictionary."""
    for part in slices(batch, "text"):
        which, words, before = terms(part.column("text"))
        langs = part.column("lang").to_pylist()
        names = list(zip(langs, part.column("source").to_pylist(), strict=True)) if by_source else [(x,) for x in langs]
        code = {g: i for i, g in enumerate(dict.fromkeys(names))}
        group = np.array([code[x] for x in names], dtype=np.int64)
        size = max(1, len(words))
        doc = np.repeat(np.arange(len(names), dtype=np.int64), np.diff(before))
        pair, n = np.unique(doc * size + which, return_counts=True)
        key, at = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
        times = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
        yield list(code), key // size, key % size, times, np.bincount(at, minlength=len(key)), words


def _keys(groups: list[tuple], group: np.ndarray, term: np.ndarray, words: pa.Array) -> np.ndarray:
    """A 64-bit key for each (language, term)."""
    hashes, _ = word_hashes(words)
    seeds = np.array([_seed(g[0]) for g in groups], dtype=np.uint64)
    return mix64(hashes[term] ^ seeds[group])


def sketch(docs: DataFrame, bits: int, least_docs: int) -> np.ndarray:
    """Which cells of the merged sketch reach least_docs, as packed bits: DEPTH x 2^bits of them, whatever the input's size.

    Counts saturate at least_docs, in a task and in the sum: a sum of saturated counts reaches it whenever the true one does.
    """
    top = min(255, least_docs)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(DEPTH << bits, dtype=np.uint8)
        for batch in it:
            for groups, group, term, _, n, words in _counted(batch, False):
                for rows in _cells(_keys(groups, group, term, words), bits) if len(term) else []:
                    cell, at = np.unique(rows, return_inverse=True)
                    total = np.bincount(at, weights=np.minimum(n, top), minlength=len(cell)) + cells[cell]
                    cells[cell] = np.minimum(total, top).astype(np.uint8)
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in np.flatnonzero(cells.reshape(-1, CHUNK).any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "cells": pa.array([pack(cells[i * CHUNK : (i + 1) * CHUNK].tobytes())], pa.binary())})

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        chunk, cells = None, np.zeros(0, dtype=np.uint16)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "full": pa.array([np.packbits(cells >= top).tobytes()], pa.binary())})

        for batch in it:
            for i, data in zip(batch.column("chunk").to_pylist(), batch.column("cells"), strict=True):
                if i != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, cells = i, np.zeros(CHUNK, dtype=np.uint16)
                cells = np.minimum(cells + np.frombuffer(unpack(data.as_buffer()), dtype=np.uint8), top).astype(np.uint16)
        if chunk is not None:
            yield done()

    parts = batches(docs.select("text", "lang"), count, "chunk int, cells binary")
    merged = batches(parts.repartition("chunk").sortWithinPartitions("chunk"), merge, "chunk int, full binary")
    full = np.zeros((DEPTH << bits) // 8, dtype=np.uint8)
    for row in merged.collect():  # at most DEPTH x 2^bits bits
        full[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(row.full, dtype=np.uint8)
    return full


def count_terms(docs: DataFrame, least_docs: int = 10, max_bits: int = 26) -> DataFrame:
    """(lang, source, term, n, docs): exact counts of all terms that the sketch leaves possible, for each task and slice of its texts."""
    rows = docs.count()
    bits = max(16, min(max_bits, rows.bit_length() + 4))
    full = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits, least_docs))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = full.value
        for batch in it:
            for groups, group, term, n, df, words in _counted(batch, True):
                if not len(term):
                    continue
                keep = np.ones(len(term), dtype=bool)
                for cell in _cells(_keys(groups, group, term, words), bits):
                    keep &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                group, term = group[keep], pa.array(term[keep])
                names = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, words.take(term), pa.array(n[keep]), pa.array(df[keep])], ["lang", "source", "term", "n", "docs"])

    return batches(docs.select("text", "lang", "source"), count, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), in two steps so that longs suffice up to 10^14 occurrences; null for 0 / 0."""
    b = f"nullif({total} + 2 * {kept}, 0)"
    a = f"(({n} + 2) * 31250)"
    return F.expr(f"1 + ({a} div {b}) * 32000 + ((({a}) % {b}) * 32000) div {b}")


def distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _meet(left: DataFrame, right: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Equi-join with few, hot keys: the right side is broadcast where it is small, else both sides are salted."""
    if small:
        return left.join(F.broadcast(right), on)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = scratch.save(count_terms(docs, least_docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs")
    used = scratch.save(counted.drop("docs").join(kept, ["lang", "term"]), "kept")

    # one row per group, and what it gives a term that it lacks
    langs = used.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("v"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "support", "lang_total", "v")])
    groups = scratch.save(groups.withColumn("p0", share("0", "total", "v")), "groups")
    small = groups.count() <= MOST_BROADCAST

    stats = groups.select("lang", "source", "total", "lang_total", "v", "p0")
    used = _meet(used, stats, ["lang", "source"], small) if small else used.join(stats, ["lang", "source"])
    used = scratch.save(used.select("lang", "source", "term", "p0", share("n", "total", "v").alias("p"), share("all_n", "lang_total", "v").alias("q")), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    # terms that both sources of a pair use: what they add to the two one-sided sums below
    one = used.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    two = used.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    shared = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.expr(f"sum({distance('pa', 'pb')} - {distance('pa', 'p0b')} - {distance('p0a', 'pb')})").alias("more"), F.count("*").alias("both"))
    # terms that a source uses against a source that doesn't: terms of equal share at once, and sources of equal p0
    levels = used.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("p0").alias("other")).distinct()
    alone = scratch.save(_meet(levels, others, ["lang"], small).groupBy("lang", "source", "other").agg(F.expr(f"sum(n * ({distance('p', 'other')}))").alias("alone")), "alone")

    fields = ["source", "support", "p0"]
    sides = [groups.select("lang", "v", *[F.col(c).alias(f"{s}_{c}") for c in fields]) for s in ("a", "b")]
    pairs = _meet(sides[0], sides[1].drop("v"), ["lang"], small).where("a_source < b_source")
    pairs = pairs.join(shared.select("lang", F.col("a").alias("a_source"), F.col("b").alias("b_source"), "more", "both"), ["lang", "a_source", "b_source"], "left")
    for s, o in (("a", "b"), ("b", "a")):
        pairs = pairs.join(alone.select("lang", F.col("source").alias(f"{s}_source"), F.col("other").alias(f"{o}_p0"), F.col("alone").alias(f"{s}_alone")), ["lang", f"{s}_source", f"{o}_p0"], "left")
    zero = lambda c: f"coalesce({c}, 0)"
    value = F.expr(f"{zero('a_alone')} + {zero('b_alone')} + {zero('more')} + (v - a_support - b_support + {zero('both')}) * {zero(distance('a_p0', 'b_p0'))}")
    pairs = pairs.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), value.alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_p"))
    pairs = pairs.select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value").withColumn("rank", F.row_number().over(best))
    out = scratch.save(pairs.unionByName(told).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")), "audit")
    scratch.keep(out)
    return out
