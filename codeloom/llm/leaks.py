"""Evaluation texts that leaked into documents: pigeonhole pieces and Myers' bit-parallel distance, over words."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np

#: A passage has at least so many words, and at most one in RATE of them changed, dropped or added.
LEAST, RATE = 12, 5
#: Words of an exact piece. A passage of L words and L // 5 errors falls into L // 5 + 1 runs, one of which has three words or more.
PIECE = 3
#: Exact pieces that any passage shares with its text at least: L - PIECE + 1 of them, of which an error spoils PIECE at most.
SHARED = LEAST - PIECE + 1 - PIECE * (LEAST // RATE)
#: Passages of 24 words and more hold a shorter one within the rate, so longer ones need no look.
LONGEST = 2 * LEAST - 1
#: The shortest passages for each number of errors: every passage holds one of them with no more errors.
SHORTEST = tuple(max(LEAST, RATE * e) for e in range(LEAST // RATE, LONGEST // RATE + 1))
#: Most words of a passage as it stands in a document, with words added.
REACH = LONGEST + LONGEST // RATE
#: Texts are read in stretches of so many words, each beginning STEP words after the one before: any passage lies whole in one.
STRETCH, STEP = 128, 96
#: A text that has one in so many of an item's pieces is near it as a whole.
NEAR = 3
#: Words of the windows over which items compete, and the most errors in one that matter.
WINDOW, WINDOW_ERRORS = LEAST, LONGEST // RATE
#: Hashes of words a task remembers; beyond it the memory begins anew.
REMEMBERED = 1_000_000

_WORDS = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>|#*+\-/;%!]|//+|--)+[ \t]*)*(?:\d{1,5}[.:)|\]][ \t]+)?", re.M)
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[str]:
    """The words of a text: lower case, without punctuation, line prefixes and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORDS.findall(_PREFIX.sub("", text).lower())


class Hashes(dict):
    """64-bit numbers of words, as Spark holds them."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def text_key(words: np.ndarray) -> int:
    """A number that tells texts of other words apart."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def sentences_of(text: str, hashes: Hashes) -> list[np.ndarray]:
    return [hashes.of(words_of(s)) for s in _SENTENCES.split(text)]


def piece_keys(words: np.ndarray) -> np.ndarray:
    """A number for each PIECE words in a row, order counting."""
    w = words.view(np.uint64)
    n = max(len(w) - PIECE + 1, 0)
    key = np.zeros(n, np.uint64)
    for k in range(PIECE):
        key = (key ^ (key >> np.uint64(29))) * _B + w[k : n + k] * _A
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def stretches_of(n: int) -> list[tuple[int, int]]:
    """The stretches of a text of n words."""
    return [(a, min(a + STRETCH, n)) for a in range(0, max(n - STRETCH + STEP, 1), STEP)]


def suspects(words: np.ndarray, known: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Stretches in which SHARED pieces, near enough for one passage, may be pieces of an item.

    known: a bitmap of the items' piece keys by their first `bits` bits, 32 of them a number.
    """
    if len(words) < LEAST - LEAST // RATE:
        return []
    slot = piece_keys(words).view(np.uint64) >> np.uint64(64 - bits)
    at = np.nonzero((known[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1))[0]
    first, last = at[: len(at) - SHARED + 1], at[SHARED - 1 :]
    near = last - first <= REACH - PIECE
    if not near.any():
        return []
    first, last = first[near], last[near] + PIECE
    return [(a, b) for a, b in stretches_of(len(words)) if ((first >= a) & (last <= b)).any()]


def distances(patterns: list[int], size: int, text: list[int]) -> np.ndarray:
    """Least edit distances (Myers 1999) of all runs of `size` words of `patterns` to what ends at each word of `text`.

    All runs are matched at once: each has its own 16 or 32 bits of one long number,
    of which the lowest `size` (31 at most) are its column of differences. Rows of the
    result are the words of the text, columns the first words of the runs.
    """
    width, kind = (16, np.uint16) if size < 16 else (32, np.uint32)
    lanes = len(patterns) - size + 1
    ones = ((1 << (width * lanes)) - 1) // ((1 << width) - 1)
    full = ones * ((1 << size) - 1)
    top = ones << (size - 1)
    stair = sum(1 << (width * (size - 1 - k) + k) for k in range(size))
    masks: dict[int, int] = {}
    for p, w in enumerate(patterns):
        by = width * (p - size + 1)
        masks[w] = masks.get(w, 0) | ((stair << by if by >= 0 else stair >> -by) & full)
    pv, mv, n = full, 0, width // 8 * lanes
    up, down = [], []
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full ^ (xh | pv))
        mh = pv & xh
        up.append((ph & top).to_bytes(n, "little"))
        down.append((mh & top).to_bytes(n, "little"))
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full ^ (xv | ph))
        mv = ph & xv
    steps = (np.frombuffer(b"".join(up), kind) != 0).astype(np.int16) - (np.frombuffer(b"".join(down), kind) != 0)
    return size + np.cumsum(steps.reshape(len(text), lanes), axis=0)


def _present(words: list[int], others: list[int]) -> np.ndarray:
    """How many of the first k words stand among the others, for each k from 0."""
    there = set(others)
    return np.concatenate(([0], np.cumsum(np.fromiter((w in there for w in words), bool, len(words)))))


def passage_ends(item: list[int], text: list[int]) -> np.ndarray | None:
    """For each window of `text` whether it lies in a passage of the item, or one in it; None if there is no passage.

    A passage begins and ends with a word that is there. Of the lengths that SHORTEST
    leaves out only the first that has a passage is looked at, where those have none.
    """
    n, m = len(text), len(item)
    upto = _present(item, text)
    # a run of which too few words stand in the text at all needs no distance
    ends = {size: distances(item, size, text) <= size // RATE for size in SHORTEST if size <= m and (upto[size:] - upto[:-size] >= size - size // RATE).any()}
    if not any(e.any() for e in ends.values()):
        return None
    here = np.diff(upto) > 0
    width = min(WINDOW, n)
    inside, found = np.zeros(n - width + 1, bool), False
    for size in (*SHORTEST, *(x for x in range(LEAST, LONGEST + 1) if x not in SHORTEST)):
        if size > m or size in SHORTEST and size not in ends or found and size not in SHORTEST:
            continue
        e = ends[size] if size in ends else distances(item, size, text) <= size // RATE
        for j in np.nonzero((e & here[: m - size + 1] & here[size - 1 :]).any(axis=1))[0].tolist():
            found = True
            inside[max(0, min(j - size + 1, j - width + 1)) : max(j - size + 1, j - width + 1) + 1] = True
    return inside if found else None


def regions(at: list[int], place: list[int], n: int, m: int) -> list[tuple[int, int, int, int]]:
    """Where passages may be: (from, to) in the text of n words and (from, to) in the item's part of m words.

    at, place: shared pieces by their places in text and item, in order of the text.
    SHARED of them must lie near enough for one passage, and as far apart in the item
    as in the text, but for its errors.
    """
    out: list[list[int]] = []
    slack = LONGEST // RATE
    for k in range(len(at) - SHARED + 1):
        a, shift = at[k], at[k] - place[k]
        same, last, end = 1, a, place[k]
        for x in range(k + 1, len(at)):
            if at[x] - a > REACH - PIECE:
                break
            if abs(at[x] - place[x] - shift) <= slack:
                same, last, end = same + (at[x] > last), at[x], max(end, place[x])
        if same >= SHARED:
            r = [max(0, a - REACH), min(n, last + PIECE + REACH), max(0, place[k] - LONGEST - slack), min(m, end + PIECE + LONGEST)]
            if out and r[0] <= out[-1][1] and r[2] <= out[-1][3] and out[-1][2] <= r[3]:
                p = out[-1]
                out[-1] = [p[0], max(p[1], r[1]), min(p[2], r[2]), max(p[3], r[3])]
            else:
                out.append(r)
    return [tuple(r) for r in out]


def compare(item: list[int], text: list[int], spans: list[tuple[int, int, int, int]]) -> tuple[bool, list[tuple[int, int, bool]]]:
    """Whether `text` holds a passage of the item within `spans`, and (place, errors, inside) of each window of `text` that is much like it.

    inside: the window lies in a passage of the item.
    """
    holds, like = False, {}
    for x, y, a, b in spans:
        here, part = text[x:y], item[a:b]
        inside = passage_ends(part, here)
        holds |= inside is not None
        width, upto = min(WINDOW, len(here)), _present(here, part)
        plausible = np.nonzero(upto[width:] - upto[:-width] >= width - WINDOW_ERRORS)[0]
        if not len(plausible):
            continue
        begin = int(plausible[0])
        errors = distances(here[begin : int(plausible[-1]) + width], width, part).min(axis=0)
        for w in np.nonzero(errors <= WINDOW_ERRORS)[0].tolist():
            w, e = begin + w, int(errors[w])
            known, i = like.get(x + w, (WINDOW, False))
            like[x + w] = (min(e, known), i or (inside is not None and bool(inside[w])))
    return holds, [(w, e, i) for w, (e, i) in sorted(like.items())]
