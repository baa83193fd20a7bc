"""Temperature mixing of sources: weights by exponentiated token shares, realised as budgeted block permutations.

Source i with token share p_i gets the weight p_i^a / sum_j p_j^a. The exponent a is bisected: in [0, 1] to the lowest one whose
largest repetition (weight x budget / tokens) stays within `max_repeats`, or from 0 up to the one whose entropy meets
`target_entropy` (a share of log n). A limit that no exponent meets is an error. A source's quota is weight x budget: so many whole
passes over its rows, then a part of one. Every pass permutes the source's rows by a hash of (seed, pass, row). The part of a pass ends
where the running token count meets the quota; that point is found by token sums per leading bits of the hash, per further bits and
then within one such cell, so no task sees a whole source.

Blocks have budgets: of each source, a block takes the next weight x `block_tokens` tokens of its permuted passes, to within a row. A row's
place in the running count comes from token sums per cell of the hash, added up over a source's cells, and from the rows before it within its own cell.

The only things broadcast are one row per source (at most `max_sources`, checked) with passes and cut.

Defined cases: a null source is a source of its own; null or empty texts have no tokens and belong to whole passes, and to a
part of one up to its cut; rows that tie in the order are kept or left together; sources without tokens get weight 0 and
no rows; an empty table gives an empty result; in copies, further columns stay as they are, but for ones named like the three added, which they replace.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch

TOKENS = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    """alpha, and per source: tokens, weight, whole passes and the tokens of the part."""

    alpha: float
    sources: list[tuple[str | None, int, float, int, float]]


def weights(tokens: list[int], alpha: float) -> list[float]:
    top = max(tokens, default=0)
    raw = [(t / top) ** alpha if t else 0.0 for t in tokens]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def solve(tokens: list[int], budget: float, max_repeats: float | None = None, target_entropy: float | None = None, steps: int = 60) -> float:
    """Bisect the exponent. Entropy falls as it grows; the largest repetition falls as it grows from 0 to 1."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    live = [t for t in tokens if t]
    if not live:
        return 1.0

    def low_enough(alpha: float) -> bool:
        w = weights(live, alpha)
        if max_repeats is not None:
            return max(x * budget / t for x, t in zip(w, live, strict=True)) <= max_repeats * (1 + 1e-12)
        return entropy(w) <= target_entropy * math.log(max(2, len(live))) + 1e-12

    lo, hi = 0.0, 1.0
    if low_enough(lo):
        return lo
    while not low_enough(hi):
        if max_repeats is not None:
            raise ValueError(f"a budget of {budget:g} tokens repeats {sum(live)} tokens more than {max_repeats:g} times at any exponent")
        if hi >= 1024:
            raise ValueError(f"no exponent brings the entropy down to {target_entropy:g} of its largest value; the largest sources tie")
        lo, hi = hi, 2 * hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if low_enough(mid) else (mid, hi)
    return hi


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long")


def _key(seed: int, epoch: Column) -> Column:
    """A row's place in a pass: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("__id"), F.col("__text")), 1)


BLOCK, SUB = 51, 39  # shifts: 4096 cells of 4096 sub-cells
CELL_ROWS = 512  # rows of a pass in one cell of the running count, on average


def mix(df: DataFrame, source: str = "source", row_id: str = "doc_id", text: str = "text", budget: float | None = None, max_repeats: float | None = 4.0, target_entropy: float | None = None, seed: int = 17, block_tokens: int = 1 << 20, max_sources: int = 50_000, blocks: bool = True) -> tuple[DataFrame, Plan]:
    """(df's columns with mix_pass, mix_key in [0, 1] and mix_block, one row per use; the plan).

    In the order of mix_key all sources advance alike. mix_block needs the rows' running token counts, and so a shuffle of
    what is selected with it; without `blocks` it is null, and rows stay where they are.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    own = {"mix_pass", "mix_key", "mix_block"}
    keyed = df.select("*", F.col(row_id).cast("string").alias("__id"), F.xxhash64(text).alias("__text"), F.col(source).alias("__source"), count_tokens(F.col(text)).alias("__n")).drop(*own)
    narrow = scratch.save(keyed.select("__source", "__id", "__text", "__n"), "rows")
    sums = narrow.groupBy("__source").agg(F.sum("__n").alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    most = max((r["rows"] for r in sums), default=0)
    sums = sorted(((r["__source"], int(r["n"])) for r in sums), key=lambda r: (r[0] is not None, r[0] or ""))
    tokens = [n for _, n in sums]
    total = sum(tokens)
    budget = float(total) if budget is None else float(budget)
    alpha = solve(tokens, budget, max_repeats, target_entropy)
    plan = Plan(alpha, [])
    for (s, n), w in zip(sums, weights(tokens, alpha), strict=True):
        whole = int(w * budget // n + 1e-12) if n else 0
        rest = max(0.0, w * budget - whole * n) if n else 0.0
        plan.sources.append((s, n, w, whole, 0.0 if rest < 1e-6 * max(1, n) else rest))
    cuts = F.broadcast(spark.createDataFrame([(s, w, r) for s, _, _, w, r in plan.sources], "s string, whole int, rest double"))

    # Where the part of a pass ends: three levels of token sums, each over one block of the level above.
    part = narrow.join(cuts, F.col("__source").eqNullSafe(F.col("s")) & (F.col("rest") > 0)).select("s", "rest", F.col("__n").alias("_n"), _key(seed, F.col("whole")).alias("k"))
    found = {s: [0, r] for s, _, _, _, r in plan.sources if r > 0}
    for shift in (BLOCK, SUB, 0):
        if not found:
            break
        here = part.groupBy("s", F.shiftrightunsigned("k", shift).alias("b")).agg(F.sum("_n").alias("n"))
        run = here.withColumn("c", F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        rests = F.broadcast(spark.createDataFrame([(s, b, float(r)) for s, (b, r) in found.items()], "s2 string, top long, left double"))
        hit = run.join(rests, F.col("s").eqNullSafe(F.col("s2"))).where(F.col("c") <= F.col("left") if shift == 0 else F.col("c") > F.col("left"))
        pick = hit.groupBy("s").agg(F.max("b").alias("b")) if shift == 0 else hit.groupBy("s").agg(F.min(F.struct("b", (F.col("c") - F.col("n")).alias("before"))).alias("m")).select("s", "m.b", "m.before")
        got = {r["s"]: r for r in pick.collect()}  # one row per source
        if shift == 0:
            found = {s: [got[s]["b"] if s in got else (b << SUB) - 1, 0] for s, (b, _) in found.items()}
        else:
            found = {s: [got[s]["b"], r - got[s]["before"]] for s, (_, r) in found.items() if s in got}
            small = F.broadcast(spark.createDataFrame([(s, b) for s, (b, _) in found.items()] or [(None, -1)], "s3 string, b3 long"))
            part = part.join(small, F.col("s").eqNullSafe(F.col("s3")) & (F.shiftrightunsigned("k", shift) == F.col("b3")), "left_semi")
    rows = [(s, whole, found.get(s, [-1])[0], (w * budget / n) if n else 1.0, w * block_tokens) for s, n, w, whole, _ in plan.sources if n]
    cut = F.broadcast(spark.createDataFrame(rows, "__s string, __whole int, __cut long, __uses double, __quota double"))
    used = keyed.join(cut, F.col("__source").eqNullSafe(F.col("__s")))
    used = used.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("__whole"))))
    used = used.withColumn("__k", _key(seed, F.col("mix_pass"))).where((F.col("mix_pass") < F.col("__whole")) | (F.col("__k") <= F.col("__cut")))
    used = used.withColumn("mix_key", F.least(F.lit(1.0), (F.col("mix_pass") + F.col("__k") / F.lit(float(1 << 63))) / F.col("__uses")))
    columns = [F.col(f"`{c}`") for c in df.columns if c not in own]
    scratch.drop(narrow)
    if not blocks:
        return used.select(*columns, "mix_pass", "mix_key", F.lit(None).cast("int").alias("mix_block")), plan
    bits = min(40, max(0, math.ceil(math.log2(max(1, most) / CELL_ROWS))))
    used = used.withColumn("__cell", F.shiftrightunsigned("__k", 63 - bits))
    cells = used.groupBy("__s", "mix_pass", "__cell").agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy("__s").orderBy("mix_pass", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("__s").alias("__s2"), F.col("mix_pass").alias("__p2"), F.col("__cell").alias("__c2"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    placed = used.join(cells, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("mix_pass") == F.col("__p2")) & (F.col("__cell") == F.col("__c2")), "left")
    within = Window.partitionBy("__s", "mix_pass", "__cell").orderBy("__k", "__n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0))
    last = max(1, math.ceil(budget / block_tokens)) - 1
    block = F.least(F.lit(last), F.floor(start / F.col("__quota"))).cast("int")
    return placed.select(*columns, "mix_pass", "mix_key", block.alias("mix_block")), plan
