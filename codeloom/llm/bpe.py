"""Byte-level BPE by replaying the merges over all words of a block of the corpus at once."""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import re

import numpy as np
import regex

# The published patterns that split text before the merges, for any text and for ASCII.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
#: Words whose ids a task remembers; beyond it the memory begins anew.
REMEMBERED = 400_000
#: Symbols beyond all ids: what stands after each word, and a place taken up by the symbol before it.
WALL, TAKEN = 0xFFFF, 0xFFFE


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a tokenizer's file; the folder is a parameter, CODELOOM_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers"), name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of texts. One per task: it remembers the ids of words it has met.

    New words of a block are laid out in one row of symbols. An inverted index leads
    from each pair of neighbours to its places; merges are applied in rank order to
    all places at once, and only the neighbours of what merged are indexed anew. A
    merge only makes pairs of higher rank, so each rank is visited once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= TAKEN:
            raise ValueError("ids are held in 16 bits: a vocabulary of more than 65,534 is not supported")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.keys: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}  # of each word in begins and sizes
        self.begins, self.sizes, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def split(text: str) -> list[str]:
        return ASCII_PATTERN.findall(text) if text.isascii() else PATTERN.findall(text)

    def learn(self, words: list[str]) -> None:
        """Replay the merges over `words`."""
        ranks, keys, bytes_of = self.ranks, self.keys, self.bytes_of
        raws = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(r) + 1 for r in raws]) - 1
        # all symbols in one row, a wall after each word
        row = self.single[np.frombuffer(b"\0".join([*raws, b""]), np.uint8)]
        row[ends] = WALL
        pair = (row[:-1] << 16) | row[1:]
        kinds, inverse = np.unique(pair, return_inverse=True)
        get = keys.get

        def key_of(k: int) -> int:
            """Rank and symbols of a pair as one number that sorts by rank; 0 if it never merges."""
            a, b = k >> 16, k & 0xFFFF
            made = ranks.get(bytes_of[a] + bytes_of[b]) if a != WALL and b != WALL else None
            key = keys[k] = 0 if made is None else (made << 32) | k
            return key

        order = np.argsort(inverse, kind="stable")
        bounds = np.searchsorted(inverse[order], np.arange(len(kinds) + 1))
        places: dict[int, list[int]] = {}
        for x, k in enumerate(kinds.tolist()):
            if (key := get(k)) is None:
                key = key_of(k)
            if key:
                places[key] = order[bounds[x] : bounds[x + 1]].tolist()
        heap = list(places)
        heapq.heapify(heap)
        push = heapq.heappush
        sym = row.tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            made, a, b = top >> 32, (top >> 16) & 0xFFFF, top & 0xFFFF
            left = made << 16
            for i in sorted(places.pop(top)):
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                sym[i], sym[j] = made, TAKEN
                k = after[i] = after[j]  # a wall ends every word, so there is always one
                before[k] = i
                pair_ = left | sym[k]
                if (key := get(pair_)) is None:
                    key = key_of(pair_)
                if key:
                    if (at := places.get(key)) is None:
                        places[key] = [i]
                        push(heap, key)
                    else:
                        at.append(i)
                h = before[i]
                if h >= 0:
                    pair_ = (sym[h] << 16) | made
                    if (key := get(pair_)) is None:
                        key = key_of(pair_)
                    if key:
                        if (at := places.get(key)) is None:
                            places[key] = [h]
                            push(heap, key)
                        else:
                            at.append(h)
        done = np.array(sym)
        kept = done < TAKEN
        upto = np.cumsum(kept)[ends]
        sizes = np.diff(upto, prepend=0)
        known = len(self.places)
        self.places.update(zip(words, range(known, known + len(words))))
        self.begins = np.concatenate((self.begins, len(self.values) + upto - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.values = np.concatenate((self.values, done[kept].astype(np.int32)))

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and where each text begins in it, then the end."""
        if len(self.places) > REMEMBERED:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.places)
        if new:
            self.learn(list(new))
        words = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        sizes = self.sizes[words]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.values[np.repeat(self.begins[words] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.concatenate(([0], np.cumsum([len(w) for w in split], dtype=np.int64)))]
