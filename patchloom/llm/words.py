"""Words `[^\\x20\\x09-\\x0D]+` of whole columns of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Words as polynomials of their bytes modulo 2**64, from prefix sums over many texts at once."""

    base = 0x9E3779B97F4A7C15

    def __init__(self, fold: bool = True) -> None:
        """fold: A-Z count as a-z."""
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.base))
        if fold:
            self.byte[65:91] = self.byte[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up, self.down = self.powers(self.base), self.powers(pow(self.base, -1, 1 << 64))

    @staticmethod
    def powers(base: int) -> np.ndarray:
        p = np.ones(1, np.uint64)
        while len(p) < CHUNK:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        return p

    def __call__(self, b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, begin and end of each word of the bytes; no word reaches over one of begins."""
        space = self.space[b]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        begins = begins[(begins > 0) & (begins < len(b))]
        first[begins] = ~space[begins]
        last[begins - 1] = ~space[begins - 1]
        first, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        low, high, back = (np.empty(len(first), np.uint64) for _ in range(3))
        total = np.zeros(1, np.uint64)
        for at in range(0, len(b), CHUNK):
            piece = b[at : at + CHUNK]
            run = np.empty(len(piece) + 1, np.uint64)
            run[0] = 0
            np.cumsum(self.byte[piece] * self.up[: len(piece)], out=run[1:])
            if at:
                run = run * np.uint64(pow(self.base, at, 1 << 64)) + total
            own = slice(*np.searchsorted(first, [at, at + len(piece)]))
            low[own] = run[first[own] - at]
            back[own] = self.down[first[own] - at] * np.uint64(pow(self.base, -at, 1 << 64))
            own = slice(*np.searchsorted(stop, [at + 1, at + len(piece) + 1]))
            high[own] = run[stop[own] - at]
            total = run[-1:]
        return mix((high - low) * back + (stop - first).astype(np.uint64)), first, stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's begin and end. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at
