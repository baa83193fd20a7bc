"""Prefix trie of conversations, built level by level, and what sharing prefixes saves.

A node of depth d is a distinct sequence of d turns (role, text); its members are the conversations that begin with it. It is named by its
depth and its smallest member. Conversations of the same turns are put together first, so the levels are built from classes: at each depth the
live classes are grouped by (parent node, next turn), which gives each new node its smallest conversation, and its name to its members. A
class alone in its node is live no more: the chain of nodes below it follows from its own turns, at once for all such classes. So there
are as many levels as the longest prefix that different conversations share has turns. Then, from the deepest level upwards, each level's nodes add
up to their parents by a join. A level is a table in the shared folder.

Turns travel as digests (SHA-256 of role and text) with the text's size in bytes; texts aren't shuffled. Groups that hold more than a
thousandth of a level's classes, of which there are a thousand at most, pass their name on by broadcast, the others by a join.

Defined cases: null role or text counts as empty; rows without a conversation id take no part; turns are ordered by number, null
first, turns of equal number by role and then by digest, so repeated rows are turns one after the other; an empty table gives no nodes;
further columns are ignored. A conversation's turns are sorted in one task (the sort spills); nothing else is bound to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch, batches

#: Ids of a class whose ids, divided by it, agree are joined before the class is hashed.
ID_SPAN = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, digest, bytes)."""
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"), by.alias("_role"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "bytes")


def share_heads(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt: each takes its first h turns from the conversation c - c % group, h = crc32(c) % most, and keeps its own after h."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_base_n")), "base", "left")
    convs = convs.withColumn("got", F.least("h", F.coalesce("_base_n", F.lit(0))))
    own = turns.join(convs.where("n > h").select("conv_id", "h", "got"), "conv_id").where("pos > h")
    heads = convs.where("got > 0").select("base", F.col("conv_id").alias("_conv"), "h").join(turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base"), "base").where("pos <= h")
    rebuilt = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "bytes")
    return convs.select("conv_id"), rebuilt.unionByName(heads.select(F.col("_conv").alias("conv_id"), "pos", "digest", "bytes"))


def _hash_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class columns, ids) in order -> a row per class with the digest of its ids, joined by commas. Holds one digest, not the ids."""
    at, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"len": pa.array([at[0]], pa.int64()), "s0": pa.array([at[1]], pa.int64()), "s1": pa.array([at[2]], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in it:
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in ("len", "s0", "s1", "ids")], strict=True):
            if key != at:
                if at is not None:
                    yield done()
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if at is not None:
        yield done()


def classes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(k, w, len, ends_sha256): conversations of equal turns, by the smallest of them; their number, their length, the digest of their ids."""
    key = ["len", "s0", "s1"]
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "pos", "digest")).alias(f"s{i}") for i in (0, 1)]
    whole = convs.distinct().join(turns.groupBy("conv_id").agg(F.count("*").alias("len"), *marks), "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in key])
    pieces = whole.groupBy(*key, F.floor(F.col("conv_id") / F.lit(ID_SPAN)).alias("_part")).agg(F.array_sort(F.collect_list("conv_id")).alias("_ids"))  # at most ID_SPAN ids
    ids = pieces.select(*key, F.array_min("_ids").alias("_first"), F.array_join("_ids", ",").alias("ids"))
    hashed = batches(ids.repartition(*key).sortWithinPartitions(*key, "_first").select(*key, "ids"), _hash_ids, "len long, s0 long, s1 long, ends_sha256 string")
    return whole.groupBy(*key).agg(F.min("conv_id").alias("k"), F.count("*").alias("w")).join(hashed, key).select("k", "w", "len", "ends_sha256")


def _down(step: DataFrame, named: DataFrame, most: int, rows: int) -> DataFrame:
    """step with its group's name, for groups of more than one class. most, rows: classes of the largest group, and of all."""
    on = ["node", "digest"]
    shared = named.where("n_classes > 1").select(*on, F.col("conv_id").alias("_name"), "n_classes")
    limit = max(1000, rows // 1000)
    if most <= limit:
        return step.join(shared.drop("n_classes"), on)
    hot = F.broadcast(shared.where(F.col("n_classes") > limit).drop("n_classes"))  # at most a thousand
    rest = step.join(hot.drop("_name"), on, "left_anti").join(shared.where(F.col("n_classes") <= limit).drop("n_classes"), on)
    return step.join(hot, on).unionByName(rest)


def trie(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    classes = scratch.save(classes_of(convs, turns), "classes")
    paths = scratch.save(turns.join(classes.select(F.col("k").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("k"), "pos", "digest", "bytes").sortWithinPartitions("pos"), "paths")
    ender = F.max(F.when(F.col("len") == F.col("_depth"), F.col("k"))).alias("ender")
    made = [F.min("k").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("n_classes"), F.max("bytes").alias("bytes"), ender]

    # downwards: levels[d] holds the nodes of depth d that are reached through nodes of several classes
    root = classes.withColumns({"_depth": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")}).groupBy().agg(*made).where("conv_id is not null")
    levels = [scratch.save(root.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_classes", "bytes", "ender"), "level")]
    top = levels[0].first()
    live = classes.where("len > 0").select("k", "w", "len", F.lit(top.conv_id if top else None).cast("long").alias("_name")) if top and top.n_classes > 1 else None
    step = None
    while live is not None:
        depth = len(levels)
        before, step = step, scratch.save(live.withColumnRenamed("_name", "node").join(paths.where(F.col("pos") == depth).drop("pos"), "k").withColumn("_depth", F.lit(depth).cast("long")), "step")
        if before is not None:
            scratch.drop(before)
        named = scratch.save(step.groupBy("node", "digest").agg(*made), "level")
        levels.append(named.withColumnRenamed("node", "parent_conv_id").drop("digest"))
        most, rows = named.agg(F.max("n_classes"), F.sum("n_classes")).first()
        if most is None:
            levels.pop()
        live = _down(step, named, most, rows).where(F.col("len") > depth).select("k", "w", "len", "_name") if most and most > 1 else None

    # chains below nodes of one class
    alone = [level.where("n_classes = 1").select(F.col("conv_id").alias("k"), F.lit(d).cast("long").alias("_top")) for d, level in enumerate(levels)]
    tails = alone[0]
    for more in alone[1:]:
        tails = tails.union(more)
    below = Window.partitionBy("k").orderBy(F.desc("pos"))
    chain = paths.drop("digest").join(tails, "k").where("pos > _top").join(classes.select("k", "w", "len"), "k")
    chain = chain.withColumn("saved_tokens", F.sum((F.col("w") - 1) * F.col("bytes")).over(below.rowsBetween(Window.unboundedPreceding, 0)))
    chain = scratch.save(chain.select("k", "pos", "_top", "w", "len", "saved_tokens"), "chains")
    firsts = chain.where(F.col("pos") == F.col("_top") + 1).select(F.col("k").alias("conv_id"), "_top", F.col("saved_tokens").alias("_tail"))

    # upwards
    done, above = [], None
    for d in range(len(levels) - 1, -1, -1):
        nodes = levels[d].join(firsts.where(F.col("_top") == d).drop("_top"), "conv_id", "left")
        if above is None:
            nodes = nodes.withColumns({"_children": F.lit(0).cast("long"), "_leaves": F.lit(0).cast("long"), "_saved": F.lit(0).cast("long")})
        else:
            up = above.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
            nodes = nodes.join(up, "conv_id", "left").fillna(0, ["_children", "_leaves", "_saved"])
        tail = F.col("_tail").isNotNull().cast("long")
        children = F.col("_children") + tail
        above = scratch.save(
            nodes.select(
                "conv_id",
                F.lit(d).cast("long").alias("depth"),
                "parent_conv_id",
                "n_convs",
                children.alias("n_children"),
                F.when(children == 0, F.lit(1).cast("long")).otherwise(F.col("_leaves") + tail).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("bytes") + F.col("_saved") + F.coalesce("_tail", F.lit(0))).alias("saved_tokens"),
                "ender",
            ),
            "nodes",
        )
        done.append(above)

    last = F.col("pos") == F.col("len")
    nodes = chain.select(F.col("k").alias("conv_id"), F.col("pos").alias("depth"), F.col("k").alias("parent_conv_id"), F.col("w").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", F.when(last, F.col("k")).alias("ender"))
    for level in done:
        nodes = nodes.unionByName(level)
    ended = nodes.where("ender is not null").join(classes.select(F.col("k").alias("ender"), "ends_sha256"), "ender")
    return ended.drop("ender").unionByName(nodes.where("ender is null").drop("ender").withColumn("ends_sha256", F.lit(EMPTY)))


def shared_prefixes(df: DataFrame, group: int = 5, most: int = 9, **columns: str) -> DataFrame:
    """The trie of conversations rebuilt by share_heads."""
    scratch = Scratch(df.sparkSession, "prefixes")
    turns = scratch.save(number_turns(df, **columns), "turns")
    convs, rebuilt = share_heads(turns, group, most)
    rebuilt = scratch.save(rebuilt, "rebuilt")
    out = scratch.save(trie(convs, rebuilt, scratch), "trie")
    scratch.keep(out)
    return out
