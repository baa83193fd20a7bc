"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at every position, all pieces that end there (its output links); each relaxes the best score of
that position from the best score where it starts. A character that no piece covers falls back to its bytes. Spaces are
escaped as U+2581 with one put in front. No piece crosses from other characters to U+2581, so texts are cut there into segments,
whose best encodings, laid end to end, are the best encoding of the text; segments repeat, so they are kept in a
bounded table. A U+2581 of the text itself is encoded by bytes, so every text comes back unchanged.

A vocabulary that was built by merges has merge ranks for scores, which are no log probabilities: their sums favour many
low-ranked pieces. Such scores are replaced by log probabilities after Zipf's law, -log(rank + 10) less the logarithm of
their sum; the result is the best segmentation under those scores, not the merge order's.

Defined cases: a null text gives a null list; the empty text gives an empty list; repeated rows give equal results; an empty
table gives an empty result; further columns are ignored. Between equal scores the longer last piece wins.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import batches, slices, with_text

SPACE = "▁"
#: Stands for a U+2581 of the text itself; a lone private code point, itself never a piece.
OWN_SPACE = ""


def load(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, kind being normal, byte or control."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(p.id_to_piece(i), p.get_score(i), "byte" if p.is_byte(i) else "control" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal") for i in range(p.vocab_size())]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]], kept: int = 200_000) -> None:
        self.pieces, self.kept = pieces, kept
        self._prepare()

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "kept": self.kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._prepare()

    def _prepare(self) -> None:
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind == "normal"]
        if all(s <= 0 and s == int(s) for _, s, _ in normal):
            norm = math.log(sum(1 / (10 - s) for _, s, _ in normal)) if normal else 0.0
            normal = [(p, -math.log(10 - s) - norm, i) for p, s, i in normal]
        self.scores = {i: s for _, s, i in normal}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == "byte"}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary lacks byte pieces")
        self.text = [p.replace(SPACE, " ").encode() for p, _, _ in self.pieces]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        for i, (_, _, kind) in enumerate(self.pieces):
            if kind == "control":
                self.text[i] = b""
        self.auto = ahocorasick.Automaton()
        for p, s, i in normal:
            self.auto.add_word(p, (len(p), s, i))
        self.auto.make_automaton()
        self.single = {p for p, _, _ in normal if len(p) == 1}
        self.fallback = min(s for _, s, _ in normal) - 10
        crossing = any(SPACE in p.lstrip(SPACE) for p, _, _ in normal)
        self.cut = None if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[int, ...]] = {}

    def viterbi(self, s: str) -> tuple[int, ...]:
        """Ids of the best encoding of an escaped string."""
        n = len(s)
        best = [0.0] + [float("-inf")] * n
        if self.single.issuperset(s):  # no fallback can be needed
            start_of, piece = [0] * (n + 1), [0] * (n + 1)
            for end, (size, score, i) in self.auto.iter(s):
                end += 1
                score += best[end - size]
                if score > best[end]:
                    best[end], start_of[end], piece[end] = score, end - size, i
            found = []
            while n:
                found.append(piece[n])
                n = start_of[n]
            return tuple(reversed(found))
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # (start, piece; -1 for bytes)
        done = 0

        def close(to: int) -> None:
            """Relax the byte fallback of the positions before `to`, in order."""
            nonlocal done
            while done < to:
                if s[done] not in self.single and best[done] + self.fallback > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + self.fallback, (done, -1)
                done += 1

        for end, (size, score, i) in self.auto.iter(s):
            close(end)  # positions up to `end` are final
            start = end + 1 - size
            if best[start] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[start] + score, (start, i)
        close(n)
        out: list[int] = []
        while n:
            start, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes[b] for b in reversed(s[start:n].replace(OWN_SPACE, SPACE).encode())]
            n = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if OWN_SPACE in text:  # keep it apart from the stand-in: both go by bytes
            return [i for k, part in enumerate(text.split(OWN_SPACE)) for i in ([self.bytes[b] for b in OWN_SPACE.encode()] if k else []) + (self._encode(part, not k))]
        return self._encode(text, True)

    def _encode(self, text: str, first: bool) -> list[int]:
        s = (SPACE if first else "") + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE)
        out: list[int] = []
        known = self.known
        for segment in self.cut.findall(s) if self.cut else [s] if s else []:
            ids = known.get(segment)
            if ids is None:
                ids = self.viterbi(segment)
                if len(segment) <= 64 and len(known) < self.kept:  # frequent segments come early
                    known[segment] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = self.text
        return b"".join([text[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode(df: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and ids array<int>. The vocabulary file is read on the driver; its pieces are broadcast."""
    given, name = with_text(df, text, keep)
    shared = df.sparkSession.sparkContext.broadcast(Codec(load(model_file)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for b in it:
            for part in slices(b, name):
                flat, ends, nulls = array("i"), [0], []
                for t in part.column(name).to_pylist():
                    if t:
                        flat.extend(codec.encode(t))
                    ends.append(len(flat))
                    nulls.append(t is None)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)), mask=pa.array(nulls, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, "ids"])

    fields = "".join(f"`{c}` {given.schema[c].dataType.simpleString()}, " for c in keep)
    return batches(given, run, f"{fields}ids array<int>")


def decode(df: DataFrame, model_file: str, ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, ids and the decoded text."""
    given = df.select(*keep, F.col(ids).alias("ids"))
    shared = df.sparkSession.sparkContext.broadcast(Codec(load(model_file)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for b in it:
            for part in slices(b, "ids"):
                out = [None if x is None else codec.decode(x.tolist()) for x in part.column("ids").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("ids"), pa.array(out, pa.string())], [*keep, "ids", "decoded"])

    fields = "".join(f"`{c}` {given.schema[c].dataType.simpleString()}, " for c in keep)
    return batches(given, run, f"{fields}ids array<int>, decoded string")
