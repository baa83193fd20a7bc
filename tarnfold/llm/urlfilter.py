"""URL allow and block lists as a trie over reversed host labels and path segments.

A rule is `host/path` with a verdict. It fits its host and all subdomains when the url's path starts with the rule's
path; the longest rule wins: more host labels first, then the longer path; between equal rules block wins. Urls that no
rule fits get the default verdict.

The trie is broadcast behind a check of its size (`max_rules` entries, `max_bytes` of text). Beyond the bound, rules are
a table and urls look up their own (host suffix, path prefix) pairs by an equi-join, which needs no broadcast.

Defined cases: a null url, or one without `://`, has an empty host and an empty path and gets the default verdict; repeated
rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


class Trie:
    """Nested dicts: reversed host labels, then "/" and path segments.

    At a host node, `None` holds the path trie. At a path node, `""` holds the unfinished last segments with rule and verdict, and `0` their
    lengths, the longest first: a segment is looked up by its beginnings of these lengths, however many rules end there.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        self.root: dict = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(("/", segment), {})
            ends = node.setdefault("", {})
            if last not in ends or (verdict == "block" and ends[last][1] != "block"):
                ends[last] = (rule, verdict)
            lengths = node.setdefault(0, [])
            at = bisect_left(lengths, -len(last), key=lambda n: -n)
            if at == len(lengths) or lengths[at] != len(last):
                lengths.insert(at, len(last))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                hosts.append(node[None])
        for paths in reversed(hosts):  # the most specific host that has a fitting rule
            best = None
            segments, node, depth = path.split("/"), paths, 0
            while node is not None:
                rest = segments[depth] if depth < len(segments) else None
                if rest is not None and "" in node:
                    found = next((node[""][rest[:n]] for n in node[0] if n <= len(rest) and rest[:n] in node[""]), None)
                    best = found or best  # a deeper rule is longer
                node = node.get(("/", rest)) if rest is not None else None
                depth += 1
            if best:
                return best
        return None


def judge_urls(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow", max_rules: int = 1_000_000, max_bytes: int = 32 << 20) -> DataFrame:
    """keep columns, then host, path, rule (null where none fits) and verdict. Rules are pairs, or a table with columns rule and verdict of any size."""
    spark = df.sparkSession
    parts = df.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("rule", "verdict").where("rule is not null")
        n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()
        if n > max_rules or size > max_bytes:
            return judge_by_join(parts, rules, default)
        rules = [tuple(r) for r in rules.collect()]
    elif len(rules) > max_rules or sum(len(r) for r, _ in rules) > max_bytes:
        return judge_by_join(parts, spark.createDataFrame(rules, "rule string, verdict string"), default)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        seen: dict[tuple[str, str], tuple[str, str] | None] = {}
        for b in it:
            found = []
            for key in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = t.match(*key)
                found.append(seen[key] or (None, default))
            out = pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "rule", "verdict"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return batches(parts, judge, f"{fields}, rule string, verdict string")


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule lists of any size: one equi-join on the (host suffix, path prefix) pairs that some rule's shape allows."""
    rules = rules.select(F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"), F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("_h"), F.when(F.instr("rule", "/") > 0, F.col("rule").substr(F.instr(F.col("rule"), "/"), F.length("rule"))).otherwise("").alias("_p"))
    # distinct numbers of labels and path lengths: at most the longest rule's
    lengths = rules.agg(F.collect_set(F.size(F.split("_h", r"\."))).alias("_hosts"), F.collect_set(F.length("_p")).alias("_lens"))
    seen = parts.select("host", "path").distinct()
    suffixes = F.transform(F.filter("_hosts", lambda n: n <= F.size(F.split("host", r"\."))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    tries = seen.join(F.broadcast(lengths)).select("host", "path", F.explode(suffixes).alias("_h"), "_lens")
    tries = tries.select("host", "path", "_h", F.explode(F.transform(F.filter("_lens", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))).alias("_p"))
    hit = tries.join(rules, ["_h", "_p"])
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.size(F.split("_h", r"\.")).alias("a"), F.length("_p").alias("b"), (F.col("_verdict") == "block").alias("c"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_best")
    out = parts.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select(*parts.columns, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
