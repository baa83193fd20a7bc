"""Language identification: script ranges narrow the candidates, then a Viterbi pass over per-word scores labels spans.

Fit: hashed character n-grams (with word bounds) of every training text are counted per language into a fixed number of
buckets, together with letters per script. The model's size is bounded by max_langs x (buckets + scripts), whatever the
corpus. Words are runs of letters with their combining marks, cut where the script changes; runs of more than 24 letters, as scripts without spaces have them,
are cut into consecutive pieces of 16 (the last one 9 to 24), whose n-grams reach over the cut, so every letter is learned and
judged and spans can begin inside a run. Predict: a word's candidates are the languages that use its script; its score is its mean n-gram log
probability, floored; a switch of language between two words costs `switch`. The prediction is the language whose spans
hold most letters, its score their share.

Defined cases: null or letterless texts give `und`, score 0 and no spans; ties go to the alphabetically first language;
repeated rows give equal results; rows with null text or null language teach nothing; a model without languages
answers `und`; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import batches, slices, with_text

#: Combining marks, which continue a word and its script, and are no letters.
_MARKS = "".join(c for c in map(chr, range(0x300, 0xFE30)) if unicodedata.category(c) in ("Mn", "Mc"))
MARK = re.compile(f"[{_MARKS}]")
PLAIN_WORD = re.compile(r"[^\W\d_]+")
MARKED_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")


def words_of(text: str) -> list[str]:
    """Runs of letters and their marks, in lower case."""
    low = text.lower()
    return (PLAIN_WORD if low.isascii() or not MARK.search(low) else MARKED_WORD).findall(low)


#: First code point of each range and its script; "" ends a range.
RANGES = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, ""), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "")]
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = [r for r, _ in RANGES]
_INDEX = [SCRIPTS.index(s) for _, s in RANGES]


#: Letters of a piece of a longer run, and of the longest run that stays whole.
PIECE, WHOLE = 16, 24


def script(word: str) -> int:
    """Script of a word's letters."""
    return _INDEX[bisect_right(_STARTS, ord(letters_of(word)[0])) - 1]


def letters_of(word: str) -> str:
    """The letters of a word or of a piece, without the mark before it and the letters after it."""
    return word.lstrip("\0").partition("\0")[0] if "\0" in word else word


def scripts_of(run: str) -> np.ndarray:
    """Script of each letter; a mark has the letter's before it."""
    out = np.fromiter(map(script, run), dtype=np.int64, count=len(run))
    for m in MARK.finditer(run):
        out[m.start()] = out[max(0, m.start() - 1)]
    return out


def plain(run: str) -> bool:
    """Whether a run of letters stays whole."""
    return len(run) <= WHOLE and (max(run) < "\u0370" or len(set(scripts_of(run).tolist())) == 1)


def pieces(run: str) -> list[str]:
    """Words of a run of letters. A piece that continues a word begins with a zero; one that is continued ends with a zero and the next three letters."""
    scripts = scripts_of(run)
    bounds = [0, *(np.flatnonzero(np.diff(scripts)) + 1).tolist(), len(run)]
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        mark = ""
        while hi - lo > WHOLE:
            out.append(f"{mark}{run[lo : lo + PIECE]}\0{run[lo + PIECE : lo + PIECE + 3]}")
            lo, mark = lo + PIECE, "\0"
        out.append(mark + run[lo:hi])
    return out


def _coded(word: str) -> tuple[bytes, int]:
    """Bytes of a piece between its bounds, and how many of them begin n-grams of its own."""
    head, cut, after = word.lstrip("\0").partition("\0")
    out = (b"" if word[0] == "\0" else b"<") + head.encode() + (b"" if cut else b">")
    return out + after.encode(), len(out)


def grams(words: list[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n = 2, 3, 4: (hash bucket of the n bytes at every position, whether they lie within one word); and the words' first positions.

    Each word stands between `<` and `>`; of a piece's following letters only the n-grams that begin before them count.
    """
    coded = [b"<%b>" % w.encode() for w in words]
    cut = [(i, *_coded(w)) for i, w in enumerate(words) if "\0" in w]
    for i, code, _ in cut:
        coded[i] = code
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint32)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))  # bytes to the word's end
    after = np.zeros(1, dtype=np.int64)
    if cut:
        after = np.zeros(len(words), dtype=np.int64)
        after[[i for i, _, _ in cut]] = [len(code) - n for _, code, n in cut]
        after = np.repeat(after, sizes)  # bytes that begin none
    out, h = [], data * np.uint32(0x9E3779B1)
    for n in (2, 3, 4):
        h = h.copy()
        h[: len(data) - n + 1] = (h[: len(data) - n + 1] ^ data[n - 1 :]) * np.uint32(0x85EBCA6B) + np.uint32(n)
        out.append(((h >> np.uint32(7)) % np.uint32(buckets), left >= np.maximum(n, after + 1)))
    return out, starts


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, floor: float = 6.0, switch: float = 8.0) -> None:
        """counts: languages x buckets; scripts: languages x scripts (letters)."""
        self.langs, self.buckets, self.floor, self.switch = langs, counts.shape[1], floor, switch
        self.logp = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * self.buckets)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = share >= 0.001

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of words in every language, the best at 0; languages that don't use a word's script are at the floor."""
        hashed, starts = grams(words, self.buckets)
        total, n = np.zeros((len(self.langs), len(words)), dtype=np.float32), np.zeros(len(words), dtype=np.float32)
        for at, inside in hashed:
            total += np.add.reduceat(self.logp[:, at] * inside, starts, axis=1)
            n += np.add.reduceat(inside.astype(np.float32), starts)
        s = 3 * (total / n).T
        uses = self.uses[:, np.fromiter(map(script, words), dtype=np.int64, count=len(words))].T
        s = np.where(uses | ~uses.any(axis=1, keepdims=True), s, -1e9)
        return np.maximum(s - s.max(axis=1, keepdims=True), -self.floor)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 15, max_langs: int = 64) -> Model:
    """Learn from every row with a text and a language."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    width = buckets + len(SCRIPTS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def spill() -> None:
            for key, count in words.items():
                total = sums.setdefault(key, np.zeros(width, dtype=np.int64))
                if not count:
                    continue
                for run in [w for w in count if not plain(w)]:
                    n = count.pop(run)
                    for piece in pieces(run):
                        count[piece] += n
                seen, n = list(count), np.fromiter(count.values(), dtype=np.int64, count=len(count))
                for lo in range(0, len(seen), 1 << 15):
                    hashed, starts = grams(seen[lo : lo + (1 << 15)], buckets)
                    each = np.repeat(n[lo : lo + (1 << 15)], np.diff(np.append(starts, len(hashed[0][0]))))
                    for at, inside in hashed:
                        total[:buckets] += np.bincount(at[inside], weights=each[inside], minlength=buckets).astype(np.int64)
                total[buckets:] += np.bincount(list(map(script, seen)), weights=n * np.fromiter((len(letters_of(w)) for w in seen), dtype=np.int64, count=len(seen)), minlength=len(SCRIPTS)).astype(np.int64)
            words.clear()

        for b in it:
            for part in slices(b, "text", 1 << 20):
                for t, key in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    words.setdefault(key, Counter()).update(words_of(t))
                if sum(map(len, words.values())) > 200_000:
                    spill()
        spill()
        for key, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counts = np.zeros((len(langs), width))
    for r in batches(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    return Model(langs, counts[:, :buckets], counts[:, buckets:])


def steady(scores: np.ndarray, switch: float) -> int:
    """The label of a document whose best path provably never switches, else -1.

    c has the highest sum, so another path has at least two stretches; of k stretches it pays for k - 1 switches or more. If no
    stretch gains over half a switch against c, staying is best.
    """
    c = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, c : c + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low[1:] = low[:-1].copy()
    low[0] = 0
    return c if (gain - low).max() < switch / 2 else -1


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word, for documents laid end to end; all documents advance together, longest first."""
    n_langs = scores.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels = np.zeros(len(scores), dtype=np.int16)
    back = np.zeros(scores.shape, dtype=np.int8 if n_langs < 128 else np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents with more than t words
    own = np.arange(n_langs)
    v = scores[starts[: alive[0]]].copy() if longest else scores[:0]
    ends = np.empty((len(lengths), n_langs), dtype=scores.dtype)
    for t in range(1, longest):
        n = alive[t]
        if n < len(v):
            ends[n : len(v)] = v[n:]
            v = v[:n]
        at = starts[:n] + t
        top = v.argmax(axis=1)
        jump = v[np.arange(n), top] - switch
        stay = v >= jump[:, None]
        back[at] = np.where(stay, own, top[:, None])
        v = np.where(stay, v, jump[:, None]) + scores[at]
    ends[: len(v)] = v
    state = ends.argmax(axis=1) if longest else np.zeros(0, dtype=int)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, lang_pred, score and spans array<struct<first, last, lang>> (numbers of words or pieces, both inclusive)."""
    given, name = with_text(df, text, keep)
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, int] = {}
        table = np.zeros((1 << 12, max(1, len(m.langs))), dtype=np.float32)
        letters = np.zeros(1 << 12, dtype=np.int64)
        for b in it:
            for part in slices(b, name, 1 << 22):
                if len(known) > 200_000:
                    known = {}
                per_text, lengths, fresh = [], [], []
                cut: dict[str, list[str]] = {}
                for t in part.column(name).to_pylist():
                    words = words_of(t) if t and m.langs else []
                    strange = set(words).difference(known)
                    cut.update((w, pieces(w)) for w in strange if w not in cut and not plain(w))
                    if not cut.keys().isdisjoint(strange):
                        words = [p for w in words for p in cut.get(w, (w,))]
                        strange = set(words).difference(known)
                    new = list(strange)
                    if new:
                        at = len(known)
                        known.update(zip(new, range(at, at + len(new)), strict=True))
                        fresh += new
                    per_text.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                    lengths.append(len(words))
                if fresh:
                    size = len(known)
                    if size > len(table):
                        table, letters = (np.concatenate([x, np.zeros((size, *x.shape[1:]), dtype=x.dtype)]) for x in (table, letters))
                    count = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, letters_of(w))) for w in fresh), dtype=np.int64, count=len(fresh))
                    letters[size - len(fresh) : size] = count
                    for lo in range(0, len(fresh), 1 << 15):
                        table[size - len(fresh) + lo : size - len(fresh) + min(len(fresh), lo + (1 << 15))] = m.score(fresh[lo : lo + (1 << 15)])
                    table[size - len(fresh) : size][count == 0] = 0
                ids = np.concatenate(per_text) if per_text else np.zeros(0, dtype=np.int32)
                sizes = np.array(lengths, dtype=np.int64)
                scores = table[ids]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                fixed = np.array([steady(scores[lo:hi], m.switch) if hi > lo else 0 for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int16)
                marks = np.repeat(fixed, sizes)
                if (fixed < 0).any():
                    marks[marks < 0] = viterbi(scores[marks < 0], sizes[fixed < 0], m.switch)
                preds, shares, spans = [], [], []
                for k in range(len(sizes)):
                    lo, hi = bounds[k], bounds[k + 1]
                    own = np.bincount(marks[lo:hi], weights=letters[ids[lo:hi]], minlength=1) if hi > lo else np.zeros(1)
                    total = own.sum()
                    preds.append(m.langs[int(own.argmax())] if total else "und")
                    shares.append(float(own.max() / total) if total else 0.0)
                    if total:
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(marks[lo:hi])) + 1, [hi - lo]])
                        spans.append([{"first": int(a), "last": int(z) - 1, "lang": m.langs[marks[lo + a]]} for a, z in zip(cut[:-1], cut[1:], strict=True)])
                    else:
                        spans.append([])
                out = [pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.list_(span))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], [*keep, "lang_pred", "score", "spans"])

    fields = "".join(f"`{c}` {given.schema[c].dataType.simpleString()}, " for c in keep)
    return batches(given, label, f"{fields}lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>")
