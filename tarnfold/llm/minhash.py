"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's set holds the 64-bit hashes of its distinct 5-word shingles; its sketch the k smallest of them. Documents with
   equal sets (by a 128-bit digest) form a class, and only classes are compared.
2. Inverted lists of retained values: two sets with similarity >= t share at least `need` of their sketches' values, save with a
   probability under 1e-7; so, with the rarest values first, they share one among each one's first k - need + 1. Only these are indexed.
3. Rounds of leaders: each list's members meet one leader of the list; a pair passes if the union sketch (the k smallest of both)
   does not rule t out, and is then verified by exact Jaccard on the full sets. Lists shrink to the components found so far.
4. The rest, exactly: every pair of a list whose components still differ is met once, at the first value they share, under a filter
   by sketches of 256, counted by matrix products (which decide sets up to that size), and then verified. As members of the list's largest component need no meeting among themselves, a large group of
   near copies costs list length x leftovers instead of its square. Long lists are cut into blocks that meet pairwise, so no task holds a list.
5. Components are those of classes; rows take their class's. Classes of more than a thousandth of the rows, a thousand at most, are broadcast
   for that, so no join deals many rows to one key.

Defined cases: A-Z are lower-cased and words are runs of bytes other than ASCII white space; fewer words than five make one
shingle; null, empty and blank texts have an empty set and are linked with nothing; rows with one id are one
document, linked with whatever any of them links with, and give a row each; rows with null ids give null components and kept true; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch, batches, mix64, runs, slices, word_hashes
from tarnfold.llm.components import components

#: Most candidate documents whose ids are broadcast to find their texts (8 bytes each); beyond it, ids are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for i in range(width):
        rolled += mix64(words[i : n - width + 1 + i] + np.uint64(0x632BE59BD9B4E019 * (i + 1) & (1 << 64) - 1))
    rolled = mix64(rolled)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif hi > lo:  # the whole short sequence, told apart by its length
            h = np.uint64(hi - lo)
            for w in words[lo:hi]:
                h = mix64(np.array([h ^ w], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(words[:0])
    return out


def sketch(df: DataFrame, doc_id: str, text: str, k: int, width: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, sketch (the k smallest hashes, shifted to signed order)."""
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, "_text"):
                sets = shingle_sets(part.column("_text"), width)
                low = [(s[:k] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]  # keeps the order
                flat = pa.array(np.concatenate(low) if low else np.zeros(0, np.int64), pa.int64())
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32))
                digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), digest, pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n", "digest", "sketch"])

    return batches(given, run, "doc_id long, n long, digest binary, sketch array<long>")


#: Hashes (their leading 32 bits) of the larger sketch that filters the pairs which leaders leave.
LARGE = 256
#: Members of a block of a list in which leftover pairs meet; a task holds two blocks.
BLOCK = 1024


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, shingles as bytes, large sketch)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, "_text"):
                sets = shingle_sets(part.column("_text"), width)
                low = [((s[:LARGE] >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32) for s in sets]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32))
                large = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(low) if low else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), large], ["doc_id", "shingles", "large"])

    return batches(df, run, "doc_id long, shingles binary, large array<int>")


def least_shared(k: int, t: float) -> int:
    """Of the k smallest values of a union, Binomial(k, t) are shared; 6.5 deviations under the mean."""
    return max(1, math.floor(k * t - 6.5 * math.sqrt(k * t * (1 - t))))


def _estimate(k: int, need: int, na: Column, nb: Column, sa: Column, sb: Column, percent: int) -> Column:
    """Whether the union sketch leaves the threshold possible. Sketches that hold whole sets are decided exactly."""
    shared = F.size(F.array_intersect(sa, sb))
    whole = (na <= k) & (nb <= k)  # two units of slack: leading bits of two hashes may agree
    lengths = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    common = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union(sa, sb)), 1, k), F.array_intersect(sa, sb)))
    return lengths & (F.when(whole, 100 * (shared + 2) >= percent * (na + nb - shared - 2)).otherwise((shared >= need) & (common >= need)))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose exact similarity on full sets meets the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part, keep = b.slice(lo, 256), []
                for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    both = int((q[at] == p).sum()) if len(q) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return batches(both, run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, k: int = 32, leader_rounds: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    t = percent / 100
    need = least_shared(k, t)
    rows = scratch.save(sketch(df, doc_id, text, k, width), "sketches")
    full = rows.where("n > 0 and doc_id is not null")
    copies = scratch.save(full.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")), "classes")
    repeated = bool(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())
    classes = copies.select("rep", "n", "sketch")

    # Retained values that occur in two classes or more; each class indexes its rarest.
    values = classes.select("rep", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    kept = values.join(common, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("vs"))
    size = F.size("sketch")
    wanted = F.greatest(F.lit(1), F.least(F.lit(need), F.ceil(size * t).cast("int")))  # small sets: t of the set itself
    room = F.greatest(F.lit(0), size - wanted + 1 - (size - F.size("vs")))  # values of one class come first and lead nowhere
    index = kept.join(classes, "rep").select("rep", "n", "sketch", F.transform(F.slice("vs", F.lit(1), room), lambda v: v["value"]).alias("prefix"))
    index = scratch.save(index.where(F.size("prefix") > 0), "index")

    n_index = index.count()
    ids = index.select(F.col("rep").alias("doc_id"))
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).where("_text is not null")
    sets = full_sets(given.join(F.broadcast(ids) if n_index <= MOST_BROADCAST else ids, "doc_id", "left_semi"), width)
    if repeated:
        sets = sets.dropDuplicates(["doc_id", "shingles"])
    sets = scratch.save(sets, "sets")

    postings = scratch.save(index.select("rep", F.explode("prefix").alias("value")), "postings")
    members = index.select("rep", "n", "sketch")
    links = scratch.save(spark.createDataFrame([], "a long, b long"), "verified")
    found = [links]
    comp = index.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    all_links = links
    for r in range(leader_rounds):
        placed = postings.join(comp, postings.rep == comp.node).select("rep", "value", "component")
        lead = placed.groupBy("value").agg(F.min_by(F.struct("rep", "component"), F.xxhash64(F.lit(r), F.col("rep")) if r else F.col("rep")).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value", F.col("l.rep").alias("leader"), F.col("l.component").alias("theirs"))
        pairs = placed.join(lead, "value").where("component <> theirs").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        all_links = _more(pairs, members, sets, scratch, found, k, need, percent)
        comp = _placed(index, all_links, scratch)
    # What leaders left: pairs of different components, one of them outside the list's main component.
    placed = scratch.save(postings.join(comp, postings.rep == comp.node).join(index.select(F.col("rep").alias("r2"), "prefix", "n"), F.col("rep") == F.col("r2")).select("rep", "value", "component", "prefix", "n"), "placed")
    dealt = _dealt(placed).join(sets.select(F.col("doc_id").alias("r3"), "large"), F.col("rep") == F.col("r3")).drop("r3").repartition("value", "p", "q").sortWithinPartitions("value", "p", "q")
    pairs = batches(dealt, lambda it: _meet(it, percent), "a long, b long")
    all_links = _more(pairs, None, sets, scratch, found, k, need, percent)

    large = F.col("copies") > max(1000, rows.count() // 1000)
    if repeated:  # classes that share an id are linked
        of = _by_class(full, copies, large, "doc_id", "rep").distinct()
        least = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("d"), "a")
        all_links = all_links.union(of.join(least, F.col("doc_id") == F.col("d")).select("a", F.col("rep").alias("b")))
    whole = components(all_links, scratch)
    copies = scratch.save(copies.join(whole, F.col("rep") == F.col("node"), "left").select("digest", "n", "copies", F.coalesce("component", "rep").alias("component")), "placed")
    scratch.keep(rows, copies)
    out = _by_class(full, copies, large, "doc_id", "n", "component")
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    if repeated:  # an empty text's row goes with the other rows of its id
        others = out.groupBy("doc_id").agg(F.min("component").alias("c")).select(F.col("doc_id").alias("d"), "c")
        rest = rest.join(others, F.col("doc_id") == F.col("d"), "left").select("doc_id", "n", F.coalesce("c", "component").alias("component"))
    out = out.union(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _dealt(placed: DataFrame) -> DataFrame:
    """Each list's members, dealt to meetings (value, p, q) of a block p of those outside its main component, which ask, with a block q of members.

    Blocks of the main component are numbered after those of the others. An asking row goes to the blocks from its own one on, an asked one of the others to
    those up to its own, one of the main component to each block that asks: for o others and m main members 2 o m / BLOCK + o^2 / BLOCK
    rows, none of which pairs the main component with itself.
    """
    by = placed.groupBy("value", "component").agg(F.count("*").alias("c")).groupBy("value").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds"), F.max("c").alias("most"), F.sum("c").alias("size")).where("kinds > 1")
    by = by.select("value", "main", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"))
    t = placed.join(by, "value").withColumn("main", F.col("component") == F.col("main"))
    t = t.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    to = lambda p, q, asks: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(asks).alias("asks"))
    asked = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda p: to(p, F.col("others") + F.col("own"), False))
    asks = F.transform(F.sequence("own", F.col("others") + F.col("mains") - 1), lambda q: to(F.col("own"), q, True))
    among = F.transform(F.sequence(F.lit(0), "own"), lambda p: to(p, F.col("own"), False))
    t = t.withColumn("_to", F.explode(F.when(F.col("main"), asked).otherwise(F.concat(asks, among))))
    return t.select("value", "_to.p", "_to.q", "_to.asks", "rep", "component", "main", "n", "prefix")


def _shared(flat: np.ndarray, row: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int, step: int = 1024) -> np.ndarray:
    """Values that rows x and rows y share, pair by pair, of (value, row) entries; values of one row alone are left out."""
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    kept = count[at] > 1
    at, row = number[at[kept]], row[kept]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for lo in range(0, int((count > 1).sum()), step):
        here = (at >= lo) & (at < lo + step)
        has = np.zeros((rows, step), dtype=np.float32)
        has[row[here], at[here] - lo] = 1
        out += has[x] @ has[y].T
    return out


def _in_union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, how many of the smallest values of the union (as many as a row has places) lie in both; one of the two rows is full."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    rank = np.arange(both.shape[1] - 1) - np.cumsum(twice, axis=1) + twice  # of a pair's value in the union
    return (twice & (rank < a.shape[1])).sum(axis=1)


def _meet(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of an asking row and an asked one that may meet the threshold: of different components, at the first value they share."""
    need = least_shared(LARGE, percent / 100)
    for (value, p, q), held in runs(it, "value", "p", "q"):
        t = pa.Table.from_batches(held).combine_chunks()
        rep, comp, n = (t[c].to_numpy() for c in ("rep", "component", "n"))
        main, asks = (t[c].to_numpy(zero_copy_only=False) for c in ("main", "asks"))
        lists = [t[c].combine_chunks() for c in ("prefix", "large")]
        (prefix, prefix_row), (large, large_row) = ((v.flatten().to_numpy(), np.repeat(np.arange(len(rep)), v.value_lengths().to_numpy())) for v in lists)
        padded = np.full((len(rep), LARGE), 1 << 40)
        padded[large_row, np.arange(len(large)) - np.searchsorted(large_row, np.arange(len(rep)))[large_row]] = large
        before = prefix < value
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(x) or not len(y):
            continue
        # two units of slack: leading bits of two hashes may agree
        fits = _shared(prefix[before], prefix_row[before], x, y, len(rep)) == 0
        both = _shared(large, large_row, x, y, len(rep))
        for at in range(0, len(x), 128):  # in strips, so that temporaries stay small
            s, k = x[at : at + 128][:, None], both[at : at + 128]
            likely = np.where((n[s] <= LARGE) & (n[y] <= LARGE), 100 * (k + 2) >= percent * (n[s] + n[y] - k - 2), k >= need)
            likely &= (comp[s] != comp[y]) & (main[y] | (rep[s] < rep[y]) | (p != q))
            fits[at : at + 128] &= likely & (100 * np.minimum(n[s], n[y]) >= percent * np.maximum(n[s], n[y]))
        i, j = np.nonzero(fits)
        i, j = x[i], y[j]
        keep = (n[i] <= LARGE) & (n[j] <= LARGE)
        rest = np.flatnonzero(~keep)
        for lo in range(0, len(rest), 4096):
            at = rest[lo : lo + 4096]
            keep[at] = _in_union(padded[i[at]], padded[j[at]]) >= need
        a, b = rep[i[keep]], rep[j[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _by_class(rows: DataFrame, classes: DataFrame, large: Column, *cols: str) -> DataFrame:
    """Rows with their class's columns; large classes are broadcast, so that none deals its rows to one task."""
    named = [c for c in classes.columns if c not in ("digest", "n")]
    few = F.broadcast(classes.where(large).select(F.col("digest").alias("_d"), F.col("n").alias("_m"), *named))
    own = rows.select("doc_id", "digest", "n").join(few, (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("_m")), "left")
    rest = own.where("copies is null").select("doc_id", "digest", "n").join(classes.where(~large), ["digest", "n"])
    return own.where("copies is not null").select(*cols).union(rest.select(*cols))


def _more(pairs: DataFrame, members: DataFrame | None, sets: DataFrame, scratch: Scratch, found: list[DataFrame], k: int, need: int, percent: int) -> DataFrame:
    """Filter pairs by their union sketch (unless that is done), verify them, and add them to the links found."""
    if members is not None:
        pairs = _likely(pairs, members, k, need, percent)
    found.append(scratch.save(_verify(pairs, sets, percent), "verified"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _likely(pairs: DataFrame, members: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    a = members.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = members.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(_estimate(k, need, F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)).select("a", "b")


def _placed(index: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every class of the index."""
    got = components(links, scratch).withColumnRenamed("node", "n2")
    reps = index.select(F.col("rep").alias("node"))
    return scratch.save(reps.join(got, reps.node == got.n2, "left").select("node", F.coalesce("component", "node").alias("component")), "components")
