"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np

_HEADING = re.compile(r"^(#{1,6})[ \t]+\S.*$", re.M)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_BLANK = re.compile(r"\n[ \t\r]*\n\s*?(?=[ \t]*\S)")
_LINE = re.compile(r"\n+")
_ITEM = re.compile(r"\n(?=[ \t]{0,3}(?:[-*+]|\d+[.)])[ \t])")
_SENTENCE = re.compile(r"(?<=[.!?;:。！？；])[\"')\]]*(?:\s+|(?<=[。！？；]))")
_WORD = re.compile(r"\s+")


def _headings(text: str, a: int, b: int, fenced: list[tuple[int, int]]) -> list[int]:
    """Begins of the sections under the highest headings in text[a:b]."""
    found = [(len(m[1]), m.start()) for m in _HEADING.finditer(text, a, b) if m.start() > a and not any(x <= m.start() < y for x, y in fenced)]
    top = min((n for n, _ in found), default=0)
    return [at for n, at in found if n == top]


def _cuts(text: str, a: int, b: int, level: int, fenced: list[tuple[int, int]]) -> list[int]:
    """Char positions at which the node text[a:b] falls into children of the level."""
    if level == 0:
        return _headings(text, a, b, fenced)
    pattern = (_BLANK, _ITEM, _LINE, _SENTENCE, _WORD)[level - 1]
    cuts = [m.end() for m in pattern.finditer(text, a, b)]
    if level in (1, 2):
        cuts = [c for c in cuts if not any(x < c < y for x, y in fenced)]
    return cuts


def cut_tokens(text: str, starts: list[int], limit: int, overlap: int, whole_chars: bool, raw: bytes | None = None) -> list[int]:
    """Token positions at which `text` is cut: 0, ..., number of tokens.

    The text is a tree: sections by headings, blocks, list items, lines, sentences,
    words. A node within `limit` - `overlap` tokens stays whole, a larger one falls
    into its children, and neighbours are merged from the bottom up while they fit.
    starts: first char (byte if not whole_chars) of each token, then the end.
    """
    room, n = limit - overlap, len(starts) - 1
    fenced = [m.span() for m in _FENCE.finditer(text)]
    if not whole_chars:  # token starts count bytes
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = [0, *np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).tolist()]
        to_char = lambda t: bisect_left(sizes, starts[t])
        to_token = lambda c: bisect_left(starts, sizes[c])
        clean = lambda t: t <= 0 or t >= n or (raw[starts[t]] & 0xC0) != 0x80
    else:
        to_char = lambda t: starts[t]
        to_token = lambda c: bisect_left(starts, c)
        clean = lambda t: True

    def fits(t: int) -> bool:
        """A cut leaves whole chars on both sides, and so does the begin of what is repeated."""
        return clean(t) and clean(t - overlap)

    def merge(units: list[list[int]], more: list[list[int]]) -> None:
        for u in more:
            if units and u[1] - units[-1][0] <= room:
                units[-1][1] = u[1]
            else:
                units.append(u)

    def pack(s: int, e: int, level: int) -> list[list[int]]:
        if e - s <= room:
            return [[s, e]]
        units: list[list[int]] = []
        if level > 5:  # one word: by tokens
            while e - s > room:
                t = s + room
                while t > s + room // 2 and not fits(t):
                    t -= 1
                if not fits(t):  # no place fits both: whole chars at the cut come first
                    t = next((x for x in range(s + room, s, -1) if clean(x)), s + room)
                units.append([s, t])
                s = t
            units.append([s, e])
            return units
        a, b = to_char(s), to_char(e)
        last = s
        inner = sorted({t for c in _cuts(text, a, b, level, fenced) if s < (t := to_token(c)) < e and fits(t)})
        if level == 0 and inner:  # sections may hold sections
            for t in [*inner, e]:
                merge(units, pack(last, t, 0 if t - last < e - s else 1))
                last = t
            return units
        for t in [*inner, e]:
            merge(units, pack(last, t, level + 1))
            last = t
        return units

    units = pack(0, n, 0)
    cuts = [u[1] for u in units]
    if len(cuts) > 1 and cuts[0] < overlap:
        # the first piece must hold what the second repeats: take as much as fits of the second, at its best place
        for level in range(6):
            a, b = to_char(overlap), to_char(min(room, n - 1))
            inner = [t for c in _cuts(text, a, b, level, fenced) if overlap <= (t := to_token(c)) <= room and t < cuts[1] and fits(t)]
            if inner:
                cuts[0] = inner[-1]
                break
        else:
            cuts[0] = next((t for t in range(room, overlap - 1, -1) if t < cuts[1] and fits(t)), overlap)
    return [0, *cuts]
