"""Dataset curation: gates, funnels, decontamination, dedup, hash-ordered sampling, splits and batches."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.sources.files import scratch

#: Bytes of items in one automaton.
SHARD = 1 << 22
#: Above this many keys an evaluation set is joined by a shuffle instead of a broadcast.
MOST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    """Lower case, LaTeX spacing dropped, white space collapsed. (NFKC is functions.text.nfkc, outside the JVM.)"""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\\[,!;:]", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def hash_order(seed: int | str, *cols: Column) -> Column:
    """A reproducible shuffle: order by this, then by id."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def short_order(h: Column) -> Column:
    """The order of a hexadecimal hash by its first 128 bits, a quarter as long."""
    return F.unhex(F.substring(h, 1, 32))


def hash_uniform(c: Column) -> Column:
    """sha256's first 32 bits over 0xFFFFFFFF."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def hash_split(c: Column, share: float, held: str = "val", rest: str = "train") -> Column:
    return F.when(hash_uniform(c) < share, held).otherwise(rest)


def small(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """A broadcast hint, behind a count of its rows; unchanged beyond the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def decontaminate(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not in the held-out set, rows whose key is)."""
    keys = small(held.select(key).distinct())
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by order. Partial aggregation instead of a window, so a hot key is combined before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def merge_tags(df: DataFrame, key: str, tags: str) -> DataFrame:
    """Upsert by key with the union of tag sets, sorted."""
    return df.select(key, F.explode_outer(tags).alias("_t")).groupBy(key).agg(F.array_sort(F.collect_set("_t")).alias(tags))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, failed): rows by their first failing step, in one pass; `kept` for the rest."""
    reason = F.lit("kept")
    for name, passes in reversed(steps):
        reason = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(reason)
    return df.select(reason.alias("step")).groupBy("step").agg(F.count("*").alias("failed"))


def issues(*named: tuple[str, Column]) -> Column:
    """Sorted codes whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])))


#: Rows that are ordered in one task at most, to find the last of a first n.
EDGE = 10_000


def first_n(df: DataFrame, n: int, h: str, *ties: str) -> tuple[DataFrame, DataFrame]:
    """(rows that surely are among the first n by a hexadecimal hash column, the rest of the first n).

    The hash that cuts the order is found by counting leading digits, 4096 at a time, until few enough rows share them; only
    those are ordered, so no task holds n rows, whatever n is.
    """
    if n <= EDGE:
        return df.limit(0), df.orderBy(h, *ties).limit(max(0, n))
    prefix, before, size = "", 0, None
    while size is None or size > EDGE:
        at = len(prefix)
        digits = df.where(F.col(h).startswith(prefix)).groupBy(F.substring(h, at + 1, 3).alias("d")).agg(F.count("*").alias("n"))
        total = before
        for r in sorted(digits.collect()):
            if total + r["n"] >= n:
                break
            total += r["n"]
        else:  # fewer than n rows in all
            return df, df.limit(0)
        if not r["d"] or at >= 60:
            break
        prefix, before, size = prefix + r["d"], total, r["n"]
    edge = df.where(F.col(h).startswith(prefix)).orderBy(h, *ties).limit(n - before)
    return df.where(F.substring(h, 1, len(prefix)) < prefix), edge


def spread(df: DataFrame) -> DataFrame:
    """For costly rows of few input splits: dealt to as many tasks as there are cores. Larger inputs have splits enough and stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


#: Whether the shuffles of an execution go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, for rows that are costly to make and are asked for several times. The shuffles that made them leave the disk with the write."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def packed(text: Column) -> Column:
    """A text as bytes, digests in hexadecimal as half of them: these don't compress, so rows that carry them are as long on disk. `unpacked` gives the text."""
    digest = text.rlike("^[0-9a-f]+$") & (F.length(text) % 2 == 0)
    return F.when(digest, F.concat(F.lit(b"\x00"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x01"), text.cast("binary")))


def unpacked(code: Column) -> Column:
    rest = F.substring(code, 2, (1 << 31) - 1)
    return F.when(F.substring(code, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def scan_select(df: DataFrame, reason: Column, key: str, order: Column, tie: str, target: int) -> DataFrame:
    """The reference's single scan with early stop: rows in hash order; those with a reason go; then later copies of a key; then rows after
    the target-th survivor. Where fewer survive, the scan goes on to the end. Adds `outcome`: selected, duplicate, the reason, or unscanned.

    A key's first row is an aggregate; the target-th survivor is found by counting digits of the hash (first_n). Rows with a reason need no
    key; keys that hold more than a thousandth of the others, a thousand at most, are broadcast, the rest are joined.
    """
    ranked = df.withColumn("_o", order).withColumn("_reason", reason)
    fine = ranked.where("_reason is null")
    first = fine.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("_o", tie)).alias("_f"), F.count("*").alias("_c"))
    often = F.col("_c") > max(1000, fine.count() // 1000)
    hot, cold = F.broadcast(first.where(often).drop("_c")), first.where(~often).drop("_c")
    same = F.col(key).eqNullSafe(F.col("_key"))
    told = fine.join(hot, same).unionByName(fine.join(hot.select("_key"), same, "left_anti").join(cold, same)).drop("_key")
    marked = told.withColumn("_dup", F.struct("_o", tie) != F.col("_f")).unionByName(ranked.where("_reason is not null").withColumn("_dup", F.lit(False)), allowMissingColumns=True)
    survivors = first.select(F.col("_f._o").alias("_o"), F.col(f"_f.{tie}").alias(tie))
    _, edge = first_n(survivors, target, "_o", tie)  # where fewer survive, a short edge or none
    last = edge.agg(F.when(F.lit(target > EDGE) | (F.count("*") == target), F.max(F.struct("_o", tie))).alias("_last"))
    out = marked.join(F.broadcast(last))
    state = F.when(F.struct("_o", tie) > F.col("_last"), "unscanned").when(F.col("_reason").isNotNull(), F.col("_reason")).when(F.col("_dup"), "duplicate").otherwise("selected")
    return out.withColumn("outcome", state).drop("_f", "_dup", "_last", "_reason")


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", without: tuple[str, ...] = ()) -> DataFrame:
    """0-based global position by order: range partitions, sorted and numbered within, and counts per partition; no single-partition window.

    The numbered rows are written once, `without` columns that only ordered them, as a second computation of the ranges would draw other bounds.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).drop(*without)
    dealt = kept(local, "index").withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_b")).cast("long")).drop("_p", "_i", "_b")


def dense_counts(df: DataFrame, index: str, keys: list[str], *more: str) -> tuple[DataFrame, DataFrame]:
    """(rows by keys and `more`: n; rows by keys: indices, how many different ones there are if they run from 0 without a gap, else null).

    Indices are counted exactly, as bits in blocks of 32768: rows that are written in their order send few blocks, not each index.
    """
    block, bit = F.bitmap_bucket_number(F.col(index)).alias("_block"), F.bitmap_bit_position(F.col(index))
    counted = [F.count("*").alias("_n"), F.min(index).alias("_least"), F.max(index).alias("_most"), F.bitmap_construct_agg(bit).alias("_bits")]
    blocks = kept(df.groupBy(*keys, *more, block).agg(*counted), "blocks")
    counts = blocks.groupBy(*keys, *more).agg(F.sum("_n").alias("n"))
    whole = blocks.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"), F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_d"))
    dense = whole.groupBy(*keys).agg(F.when((F.min("_least") == 0) & (F.max("_most") == F.sum("_n") - 1), F.sum("_d")).alias("indices"))
    return counts, dense


def containing(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item: str, width: int = 4) -> DataFrame:
    """Ids of documents that hold an item's whole text, by an index of word windows.

    A text that holds an item holds the item's inner words as whole words, between the same white space. So the item is indexed by one
    window of `width` inner words (the one with the lowest hash), documents by all of theirs; ids that meet are verified by
    `contains`. Items of one or two words have no inner words: these are looked for by automata (holding).
    """
    known = items.select(F.col(item).alias("_item")).where("_item is not null").distinct()
    words = F.split("_item", r"\s+")
    long_ = known.withColumn("_w", words).where(F.size("_w") > 2).withColumn("_k", F.least(F.lit(width), F.size("_w") - 2))
    window = lambda w, i, k: F.xxhash64(k, F.array_join(F.slice(w, i, k), " "))
    keyed = long_.select("_item", "_k", F.array_min(F.transform(F.sequence(F.lit(2), F.size("_w") - F.col("_k")), lambda i: window(F.col("_w"), i, F.col("_k")))).alias("_key"))
    widths = [r[0] for r in keyed.select("_k").distinct().collect()]  # 1 to width
    own = docs.select(F.col(doc_id).alias("_id"), F.split(text, r"\s+").alias("_w"))
    none = F.array().cast("array<bigint>")
    all_of = lambda k: F.transform(F.sequence(F.lit(1), F.size("_w") - (k - 1)), lambda i: window(F.col("_w"), i, F.lit(k)))
    keys = [F.when(F.size("_w") >= k, all_of(k)).otherwise(none) for k in widths]
    met = own.select("_id", F.explode(F.array_distinct(F.concat(*keys) if keys else none)).alias("_key")).join(small(keyed.select("_key", "_item")), "_key")
    met = met.select("_id", "_item").distinct()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = texts.join(met, "_id").where(F.contains("_text", "_item")).select("_id")
    short = known.where(F.size(words) <= 2)
    return found.union(holding(texts, short)).distinct().select(F.col("_id").alias(doc_id))


def holding(texts: DataFrame, items: DataFrame, most: int = SHARD) -> DataFrame:
    """_id of texts (_id, _text) that hold one of the items (_item), by automata over the items: one pass over a text for all items of a shard.

    Items are dealt to shards of about `most` bytes. One shard is broadcast; with more, a text goes to each shard, whose task builds the
    automaton before it reads texts, so that a task's memory doesn't grow with the items.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("_item") + 32), F.lit(0))).first()[0]
    if not size:
        return texts.select("_id").limit(0)
    shards = -(-size // most)
    if shards == 1:
        words = [r[0] for r in items.select("_item").collect()]  # within `most` bytes
        return texts.select("_id", "_text").mapInArrow(lambda it: _scan(it, automaton(words), "" in words), texts.select("_id").schema)
    of = F.pmod(F.xxhash64("_item"), F.lit(shards)).cast("int")
    none = F.lit(None)
    dealt = items.select(of.alias("_shard"), F.lit(0).alias("_k"), none.cast(texts.schema["_id"].dataType).alias("_id"), F.col("_item").alias("_text"))
    asked = texts.where("_text is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.lit(1).alias("_k"), "_id", "_text")
    both = dealt.union(asked).repartition(shards, "_shard").sortWithinPartitions("_shard", "_k")
    return both.mapInArrow(_scan_shards, texts.select("_id").schema)


def automaton(words: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        if w:
            a.add_word(w)
    a.make_automaton()
    return a


def _found(a: ahocorasick.Automaton, text: str | None, every: bool) -> bool:
    """every: an empty item is in each text."""
    return text is not None and (every or (len(a) > 0 and next(a.iter(text), None) is not None))


def _scan(it: Iterator[pa.RecordBatch], a: ahocorasick.Automaton, every: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield batch.select(["_id"]).filter(pa.array([_found(a, t, every) for t in batch.column("_text").to_pylist()], pa.bool_()))


def _scan_shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, words, a = None, [], None
    for batch in it:
        kept = []
        for s, k, t in zip(*[batch.column(c).to_pylist() for c in ("_shard", "_k", "_text")], strict=True):
            if s != shard:
                shard, words, a = s, [], None
            if k == 0:
                words.append(t)
                kept.append(False)
                continue
            if a is None:
                a = automaton(words)
            kept.append(_found(a, t, "" in words))
        yield batch.select(["_id"]).filter(pa.array(kept, pa.bool_()))


def batches(index: Column, size: int) -> tuple[Column, Column]:
    """(batch number, place within it) of a dense index."""
    return F.floor(index / size).cast("int"), F.pmod(index, F.lit(size)).cast("int")


def overlap(a: DataFrame, b: DataFrame, key: str) -> int:
    """Keys that two splits share; 0 is wanted."""
    return a.select(key).intersect(b.select(key)).count()
