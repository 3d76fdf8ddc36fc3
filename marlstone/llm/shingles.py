"""Hashed word shingles of whole texts, for the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit numbers of words; remembers at most LIMIT frequent ones."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def numbers(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts split at white space after lower-casing A-Z: the words' numbers, and where each text starts."""
        known, flat = self.known, []
        starts = np.zeros(len(docs) + 1, dtype=np.int64)
        for d, text in enumerate(docs):
            words = text.lower().split()
            try:
                flat.extend([known[w] for w in words])
            except KeyError:
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                flat.extend([known[w] for w in words])
            starts[d + 1] = len(flat)
        if len(known) > self.LIMIT:
            known.clear()
        return np.array(flat, dtype=np.uint64), starts


def rolling(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` numbers."""
    n = max(0, len(numbers) - size + 1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        key = key * _ODD + numbers[k : k + n]
    return mix(key)


def shingle_sets(numbers: np.ndarray, starts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; fewer words than ``size`` are one shingle, no words none."""
    keys, out = rolling(numbers, size), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(keys[a : b - size + 1]))
        elif b > a:
            out.append(mix(rolling(numbers[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
