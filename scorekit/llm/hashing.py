"""Hashes of the words in a byte array, all at once, by prefix sums."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BLOCK = 1 << 20            # bytes hashed at a time

#: Bytes that part words: ASCII white space (09 to 0D, 20), and FF, which no UTF-8 text has.
SPACE = np.zeros(256, dtype=bool)
SPACE[9:14] = SPACE[32] = SPACE[255] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Word ``b_0 .. b_n`` hashes to ``mix(sum of (b_k + 1) * BASE**k)``."""

    def __init__(self):
        self._grow(BLOCK)

    def _grow(self, n: int):
        self.power = np.cumprod(np.full(n + 1, np.uint64(BASE)))
        self.back = np.cumprod(np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64))))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """Prefix sums; ``raw`` is lower-cased by the caller if that is wanted."""
        if len(raw) > len(self.power) - 1:
            self._grow(len(raw))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[:len(raw)], out=total[1:])
        return total

    def spans(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * self.back[starts])

    def words(self, raw: np.ndarray, parts: np.ndarray = SPACE):
        """``starts, ends, hashes`` of the words of ``raw``, block by block (cut at bytes that
        part words; a word longer than a block makes its block longer)."""
        at = 0
        while at < len(raw):
            end = min(at + BLOCK, len(raw))
            while end < len(raw):
                gaps = np.flatnonzero(parts[raw[end:end + BLOCK]])
                if len(gaps):
                    end += int(gaps[0])
                    break
                end = min(end + BLOCK, len(raw))
            here = raw[at:end]
            inside = np.zeros(len(here) + 2, dtype=bool)
            inside[1:-1] = ~parts[here]
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[0::2], edges[1::2]
            if len(starts):
                yield starts + at, ends + at, self.spans(self.sums(here), starts, ends)
            at = end
