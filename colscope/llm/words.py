"""Words of many texts at once: positions and 64-bit hashes in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHORT = 512  # bytes up to which words are hashed side by side
SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word ``data[start:end]``: its blocks of eight bytes are mixed in one after the other, for all words at once; long words go through a digest."""
    size = end - start
    out = mix(size.astype(np.uint64) ^ SEED)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero(size <= SHORT)
    at = 0
    while len(live):
        block = np.ascontiguousarray(eight[start[live] + at]).view("<u8").ravel()
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        out[live] = mix((out[live] ^ block) * SEED + np.uint64(at + 1))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(data[start[k]:end[k]], digest_size=8).digest(), np.uint64)[0]
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts: doc (number of the text), start, end (in ``raw``) and hash of each word.

    Words are equal if their hashes are, up to the chance of 64-bit hashes.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.raw = b"\n".join(texts) + b"\n"
        if lower:
            self.raw = self.raw.translate(LOWER)
        data = np.frombuffer(self.raw, np.uint8)
        space = SPACES[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.hash = hash_words(data, self.start, self.end)


STEPS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions that leave room for n words)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k:len(hashes) - n + 1 + k] * STEPS[k]
    return mix(out)
