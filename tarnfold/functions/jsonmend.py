"""Judge outputs that are nearly JSON: one pass of a push-down transducer mends them and finds their objects, a cascade takes the first that parses.

The transducer reads lexemes (quotes, escapes, brackets, runs of anything else) with a state (in a string or not) and a stack (what is open). It writes
strings with backslashes that JSON or LaTeX means literally doubled, drops commas before closing brackets, and notes where each outermost
balanced object lies. Every step is linear in the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

# Wrappers and quotes that are taken off, escapes that JSON keeps.
FENCES = ("```json", "```JSON", "```")
QUOTES = str.maketrans({"“": '"', "”": '"', "’": "'"})
CONTROL = "bfnrt"

_LEXEMES = re.compile(r'(")|\\(?:(["\\/])|(u[0-9a-fA-F]{4})|([bfnrt])(?=(.?))|)|([{\[])|([}\]])|(,\s*)|[^"\\{}\[\],]+', re.DOTALL)


class Mended(NamedTuple):
    text: str
    objects: list[tuple[int, int]]


def outermost(text: str) -> str:
    """Without fences and smart quotes, from the first opening to the last closing brace."""
    for fence in FENCES:
        text = text.replace(fence, "")
    text = text.strip().translate(QUOTES)
    start, stop = text.find("{"), text.rfind("}")
    return text[start : stop + 1] if -1 < start < stop else text


def mend(text: str) -> Mended:
    """The text as JSON that parses, if it can be; and its outermost balanced objects there."""
    out: list[str] = []
    size = 0
    open_: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    string, comma = False, ""
    for m in _LEXEMES.finditer(text):
        quote, kept, code, control, after, opening, closing, sep = m.groups()
        piece = m[0]
        if string:
            if quote:
                string = False
            elif piece[0] == "\\" and not kept and not code and not (control and not after.isalpha()):
                piece = "\\\\" + piece[1:]
        else:
            if sep:
                if comma:
                    out.append(comma)
                    size += len(comma)
                comma = piece
                continue
            if closing and comma:
                comma = ""
            if comma:
                out.append(comma)
                size += len(comma)
                comma = ""
            if quote:
                string = True
            elif opening:
                open_.append((opening, size))
            elif closing and open_ and open_[-1][0] == ("{" if closing == "}" else "["):
                kind, start = open_.pop()
                if kind == "{":
                    while found and found[-1][0] > start:  # within this one
                        found.pop()
                    found.append((start, size + 1))
        out.append(piece)
        size += len(piece)
    out.append(comma)
    return Mended("".join(out), found)


def loads(text: str) -> tuple[bool, object]:
    """(whether it parses, the value)."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


class Parsed(NamedTuple):
    value: str | None
    source: str


def candidates(text: str, deep: bool) -> Iterator[tuple[str, str]]:
    """(where from, text): mended, cut out, raw; and then, with `deep`, each balanced object."""
    cut = outermost(text)
    whole = mend(cut)
    yield "repaired", whole.text
    yield "extracted", cut
    yield "raw", text.strip()
    if deep:
        for a, b in whole.objects:
            yield "object", whole.text[a:b]


def parse(text: str | None, keys: tuple[str, ...] = (), deep: bool = False) -> Parsed:
    """The first candidate that parses and, where keys are asked for, is an object that has them all; as compact JSON."""
    if text:
        for source, candidate in candidates(text, deep):
            fine, value = loads(candidate)
            if fine and (not keys or isinstance(value, dict) and all(k in value for k in keys)):
                return Parsed(json.dumps(value, separators=(",", ":"), ensure_ascii=False), source)
    return Parsed(None, "none")
