"""The closest of a list of names, by the similarity of common blocks, behind bounds that spare most comparisons.

The similarity is twice the characters in common blocks over both lengths. It can't exceed what the names' characters have in common as
multisets, which is one array operation for all names; names are compared in the order of that bound, until it falls below the best found.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Names:
    """An index of names: lengths and character counts."""

    def __init__(self, names: list[str]) -> None:
        self.names = sorted(set(names), reverse=True)  # of equally close names the last in order is wanted
        self.place = {c: i for i, c in enumerate(sorted(set("".join(self.names))))}
        self.lengths = np.array([len(n) for n in self.names], dtype=np.int64)
        self.counts = np.stack([self._counts(n) for n in self.names]) if self.names else np.zeros((0, 0), dtype=np.int64)
        self.compared = 0

    def _counts(self, text: str) -> np.ndarray:
        return np.bincount([self.place[c] for c in text if c in self.place], minlength=len(self.place))

    def bounds(self, text: str) -> np.ndarray:
        """What each name's similarity to a text is at most."""
        both = self.lengths + len(text)
        common = np.minimum(self.counts, self._counts(text)).sum(axis=1)
        return np.where(both > 0, 2.0 * common / np.maximum(both, 1), 1.0)

    def closest(self, text: str) -> str | None:
        if text in self.names:
            return text
        match = difflib.SequenceMatcher()
        match.set_seq2(text)
        best, found = -1.0, None
        bounds = self.bounds(text)
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] < best - 1e-12:
                break
            match.set_seq1(self.names[i])
            self.compared += 1
            likeness = match.ratio()
            if likeness > best or (likeness == best and self.names[i] > found):
                best, found = likeness, self.names[i]
        return found


def closest_name(c: Column, names: list[str]) -> Column:
    """The name closest to each text; null for null."""

    def rows(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Names(names)
        for texts in it:
            known = {t: index.closest(t) for t in texts.dropna().unique()}
            yield texts.map(known).astype(object).where(texts.notna(), None)

    rows.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(rows, "string")(c)


def strategy_family(family: Column, description: Column, families: list[str], keywords: dict[str, list[str]]) -> Column:
    """A family by its own name, else by the first whose keyword is in name or description, else the closest name."""
    name = F.translate(F.lower(F.trim(F.coalesce(family, F.lit("")))), "- ", "__")
    words = F.lower(F.concat(name, F.lit(" "), F.coalesce(description, F.lit(""))))
    out = closest_name(name, families)
    for kind, keys in reversed(keywords.items()):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(words, F.lit(k))
        out = F.when(hit, kind).otherwise(out)
    return F.when(name.isin(*families), name).otherwise(out)
