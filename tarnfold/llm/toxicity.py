"""Toxicity from a weighted finite-state grammar over clauses.

Tokens are read into classes: insults in four levels (words and stems, learned from labels), threat verbs, intent, copulas, targets,
negation and reported speech (short lists below). Five weighted transducers rewrite a clause's classes: the insult transducer knows
`target copula .. insult`, the threat transducer `(intent ..) verb .. target`; the target, negation and report transducers mark
insults and threats that follow their cues within a window. Their arcs have weights, which add up along a path and in composition. The five are
composed once into a single machine; every clause with a match is run through it. A document's
score is the logistic function of its clauses' arc weights, each taken log(1 + n) times where n clauses' paths hold it; so the weights
are fitted as a logistic model, on a bounded sample of labelled rows.

The sample holds all toxic rows up to half its size, and clean rows for the rest; the intercept is put back to the share
of all labelled rows. Half the sample's lexicon is weighed on the other half, so weights are not those of words that only the sample tells;
the model's lexicon is of all the sample. A word or stem is an insult if its log-odds are over 2 and its likelihood ratio G meets 2 log(number of
words and stems counted), so none is expected by chance.

Defined cases: null and empty texts have no clause and get the score of a text without matches; repeated rows get equal
scores; without labelled rows of both classes nothing is learned and every score is the smoothed share of label 1;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import Scratch, batches, slices, with_text

WORD = re.compile(r"[^\W\d_]+")
STOP = re.compile(r"[.!?;\n]")

#: Words of each class, in the classes' order of precedence after insults.
CLASSES = {
    "V": frozenset("kill hurt murder destroy stab shoot strangle beat tuer tuerai frapper umbringen töten schlagen matar mataré golpear".split()),
    "N": frozenset("not never no isnt arent wasnt dont without ne pas jamais nicht kein keine nie nunca jamás sin".split()),
    "R": frozenset("said says say quote quoted wrote told reported dit dire écrit sagte sagt schrieb dijo dice escribió".split()),
    "T": frozenset("you your youre he she they them him her tu vous toi ton votre du dich dein ihr euch sie usted ustedes tú vosotros ellos".split()),
    "C": frozenset("are is am was were be such a an the es est êtes sont bist ist seid sind eres sois son".split()),
    "W": frozenset("will ill gonna going shall want hope should vais veux werde will voy quiero ojalá".split()),
}
LEVELS = 4
#: Arc weights' names: insults by level, then what the marks add, and threats.
ARCS = [*[f"insult{k}" for k in range(LEVELS)], "addressed", "threat", "intent", "aimed", "negated", "reported"]
PREFIXES = range(3, 10)


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) -> (state, symbol, names of the arc's weights).

    A symbol is a class (with an insult's level) and marks: i insult, h threat, t aimed, n negated, r reported.
    """

    def __init__(self, start, step) -> None:  # noqa: ANN001
        self.start, self._step, self._arcs = start, step, {}

    def step(self, state, symbol):  # noqa: ANN001, ANN201
        key = (state, symbol)
        if key not in self._arcs:
            self._arcs[key] = self._step(state, symbol)
        return self._arcs[key]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: this one's output is the other one's input; weights add."""

        def step(state, symbol):  # noqa: ANN001, ANN202
            a, out, mine = self.step(state[0], symbol)
            b, out, theirs = other.step(state[1], out)
            return (a, b), out, mine + theirs

        return Transducer((self.start, other.start), step)

    def run(self, symbols: list[str]) -> tuple[list[str], list[str]]:
        """(output symbols, weights' names along the path)."""
        state, out, path = self.start, [], []
        for s in symbols:
            state, o, names = self.step(state, s)
            out.append(o)
            path += names
        return out, path


def insults(gap: int = 3) -> Transducer:
    """Marks insults; `target copula (up to gap words) insult` is addressed. States: 0, 1 after a target, 2.. tokens left after its copula."""

    def step(state: int, symbol: str) -> tuple[int, str, tuple[str, ...]]:
        if symbol[0] == "I":
            return 0, symbol + "i", (f"insult{symbol[1]}", *(["addressed"] if state >= 2 else []))
        if symbol[0] == "T":
            return 1, symbol, ()
        if symbol[0] == "C" and state:
            return 2 + gap, symbol, ()
        return (state - 1 if state > 2 else 0), symbol, ()

    return Transducer(0, step)


def threats(gap: int = 2) -> Transducer:
    """Marks the target that ends `(intent, up to gap words) verb (up to gap words) target`. States: (tokens left after intent, after a verb, whether that had an intent)."""

    def step(state: tuple[int, int, bool], symbol: str) -> tuple[tuple[int, int, bool], str, tuple[str, ...]]:
        will, verb, meant = state
        if symbol[0] == "V":
            return (0, gap + 1, will > 0), symbol, ()
        if symbol[0] == "T" and verb:
            return (0, 0, False), symbol + "h", ("threat", *(["intent"] if meant else []))
        if symbol[0] == "W":
            return (gap + 1, max(0, verb - 1), meant), symbol, ()
        return (max(0, will - 1), max(0, verb - 1), meant and verb > 1), symbol, ()

    return Transducer((0, 0, False), step)


def marker(cue: str, mark: str, name: str, window: int) -> Transducer:
    """Marks insults and threats that follow a cue within `window` tokens. State: tokens left."""

    def step(left: int, symbol: str) -> tuple[int, str, tuple[str, ...]]:
        hit = left > 0 and ("i" in symbol or "h" in symbol)
        return (window if symbol[0] == cue else max(0, left - 1)), symbol + mark if hit else symbol, (name,) if hit else ()

    return Transducer(0, step)


def parts(target: int = 5, negation: int = 3, report: int = 8) -> list[Transducer]:
    return [insults(), threats(), marker("T", "t", "aimed", target), marker("N", "n", "negated", negation), marker("R", "r", "reported", report)]


def grammar() -> Transducer:
    """The five composed."""
    first, *rest = parts()
    for t in rest:
        first = first @ t
    return first


class Model:
    """lexicon: word or stem (ending in *) -> level; beta: intercept and the weight of each name in ARCS."""

    def __init__(self, lexicon: dict[str, int], beta: np.ndarray) -> None:
        self.lexicon, self.beta = lexicon, beta
        self._ready = False

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "beta": self.beta, "_ready": False}

    def _prepare(self) -> None:
        self.words = {k: v for k, v in self.lexicon.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in self.lexicon.items() if k.endswith("*")}
        self.finder = ahocorasick.Automaton()
        for k in {*self.words, *self.stems, *CLASSES["V"]}:
            self.finder.add_word(k, len(k))
        self.finder.make_automaton()
        self.machine, self.read = grammar(), {}
        self.place = {name: i for i, name in enumerate(ARCS)}
        self._ready = True

    def token(self, word: str) -> str:
        """A token's class; of insults with their level, where the longest stem counts."""
        got = self.read.get(word)
        if got is None:
            level = self.words.get(word)
            if level is None:
                level = next((self.stems[word[:n]] for n in range(len(word), 0, -1) if word[:n] in self.stems), None)
            got = next((k for k, words in CLASSES.items() if word in words), "X") if level is None else f"I{level}"
            if len(self.read) > 200_000:
                self.read.clear()
            self.read[word] = got
        return got

    def clauses(self, text: str | None) -> Iterator[list[str]]:
        """The weights' names along the path of every matched clause."""
        if not self._ready:
            self._prepare()
        low = text.lower() if text else ""
        done, stops = -1, None
        for at in sorted(end - n + 1 for end, n in self.finder.iter(low) if end == n - 1 or not low[end - n].isalpha()):
            if at <= done:
                continue
            if stops is None:
                stops = [m.start() for m in STOP.finditer(low)]
            after = bisect_left(stops, at)
            begin = stops[after - 1] + 1 if after else 0
            done = stops[after] if after < len(stops) else len(low)
            _, path = self.machine.run([self.token(w) for w in WORD.findall(low[begin:done])])
            if path:
                yield path

    def features(self, text: str | None) -> list[float]:
        """log(1 + n) of how often each arc weight occurs on the paths of the text's clauses."""
        out = [0.0] * len(ARCS)
        for path in self.clauses(text):
            for name in path:
                out[self.place[name]] += 1
        return [math.log1p(n) for n in out]

    def score(self, text: str | None) -> float:
        z = float(self.beta[0]) + sum(b * x for b, x in zip(self.beta[1:].tolist(), self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _doc_features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, least_odds: float = 2.0) -> Model:
    """Learn lexicon and weights from at most `max_rows` labelled rows, those of each label with the lowest hashes of their ids.

    The sample bounds everything that reaches the driver; it is broadcast (16 bytes a row) to find its texts.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    all_pos, all_neg = marked.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    n_pos = min(all_pos, max(max_rows // 2, max_rows - all_neg))
    first = lambda which, n: marked.where(which).orderBy(F.xxhash64("_id"), "_id").limit(n)
    some = first(F.col("y") > 0, n_pos).union(first(F.col("y") <= 0, max_rows - n_pos))
    scratch = Scratch(spark, "toxicity")
    sample = scratch.save(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(some), "_id").select("text", "y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")), "sample")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            f, fold, y = zip(*seen, strict=True) if seen else ((), (), ())
            n = list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(n, pa.int64())], ["f", "fold", "y", "n"])

        for b in it:
            for t, y, fold in zip(*(b.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                seen.update((f, fold, int(y > 0)) for f in _doc_features(t))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    n = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", (F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get((0, 1), 0) + n.get((1, 1), 0), n.get((0, 0), 0) + n.get((1, 0), 0)
    prior = math.log((pos + 1) / (neg + 1))
    if not pos or not neg:
        scratch.drop(sample)
        return Model({}, np.array([prior] + [0.0] * len(ARCS)))
    cells = {(fold, y): F.sum(F.when((F.col("fold") == fold) & (F.col("y") == y), F.col("n")).otherwise(0)) for fold in (0, 1) for y in (0, 1)}
    counts = batches(sample, count, "f string, fold int, y int, n long").groupBy("f").agg(*[c.alias(f"n{fold}{y}") for (fold, y), c in cells.items()])
    counts = scratch.save(counts, "counts")
    found = counts.count()
    # One lexicon of each fold, to be weighed on the other one, and one of both.
    levels = {}
    for name, folds in (("l0", (0,)), ("l1", (1,)), ("both", (0, 1))):
        p, q = (sum(n.get((f, y), 0) for f in folds) for y in (1, 0))
        a, b = (sum((F.col(f"n{f}{y}") for f in folds), F.lit(0)) for y in (1, 0))
        levels[name] = _level(a, b, p, q, found, least_odds)
    chosen = counts.select("f", *[c.alias(k) for k, c in levels.items()]).where(" or ".join(f"{k} is not null" for k in levels)).collect()
    scratch.drop(counts)
    lexicons = {k: {r["f"]: r[k] for r in chosen if r[k] is not None} for k in levels}
    shared = spark.sparkContext.broadcast([Model(lexicons["l1"], np.zeros(1)), Model(lexicons["l0"], np.zeros(1))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [shared.value[fold].features(t) for t, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    grouped = batches(sample, rows, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    x = np.array([[1.0, *r["x"]] for r in grouped])
    y, w = np.array([float(r["y"] > 0) for r in grouped]), np.array([float(r["n"]) for r in grouped])
    scratch.drop(sample)
    model = Model(lexicons["both"], logistic(x, y, w, prior))
    model.beta[0] += math.log((all_pos + 1) / (all_neg + 1)) - prior  # the sample's share of toxic rows is not the labels'
    return model


def _level(a: Column, b: Column, pos: int, neg: int, found: int, least_odds: float) -> Column:
    """Level of a word in a toxic and b clean rows of so many, or null where it is no insult."""
    if not pos or not neg:
        return F.lit(None).cast("int")
    odds = F.log((a + 0.5) / (pos + 1.0)) - F.log((b + 0.5) / (neg + 1.0))
    share = lambda k, p: F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)
    ratio = 2 * (share(a, pos / (pos + neg)) + share(b, neg / (pos + neg)))
    step = max(1e-9, (math.log(2.0 * (neg + 1)) - least_odds) / LEVELS)  # up to what a word of all toxic rows alone has
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor((odds - least_odds) / step))).cast("int")
    return F.when((odds > least_odds) & (ratio >= 2 * math.log(max(2, found))), level)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float, ridge: float = 0.2) -> np.ndarray:
    """Ridge-penalised logistic regression on scaled features, by Newton steps that are halved until the loss falls."""
    scale = np.sqrt(np.average(x * x, axis=0, weights=w))
    scale[scale == 0] = 1.0
    z = x / scale
    penalty = np.array([1e-6] + [ridge] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    beta[0] = prior * scale[0]

    def loss(b: np.ndarray) -> float:
        t = z @ b
        return float((w * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (penalty * b * b).sum())

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (w * (y - p)) - penalty * beta)
        size = 1.0
        while size > 1e-6 and (new := loss(beta + size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9 * max(1.0, abs(now)):
            break
        beta, now = beta + size * step, new
    return beta / scale


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and score (0 to 1)."""
    given, name = with_text(df, text, keep)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, name):
                got = [shared.value.score(t) for t in part.column(name).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.float64())], [*keep, "score"])

    fields = "".join(f"`{c}` {given.schema[c].dataType.simpleString()}, " for c in keep)
    return batches(given, run, f"{fields}score double")
