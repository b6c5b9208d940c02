"""Hashes of words and of runs of words, for many texts at once, in numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hashes a worker keeps; beyond, it starts anew.
MOST_KNOWN = 200_000
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 512
_known: dict[bytes, int] = {}


def rest() -> None:
    """Gives back what a worker holds but needs no more: workers stay alive between tasks and stages."""
    _known.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_lists(texts) -> list[list[bytes]]:
    """The words of each text as bytes (they split at space and 0x09 to 0x0D); null has none."""
    return [[] if t is None else t.encode("utf-8", "surrogatepass").split() for t in texts]


def word_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in a row, and the number of words of each text."""
    if len(_known) > MOST_KNOWN:
        _known.clear()
    known, digest = _known, xxhash.xxh3_64_intdigest
    for words in lists:
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
    counts = np.array([len(w) for w in lists], np.int64)
    flat = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for words in lists:
        flat[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        at += len(words)
    return flat, counts


class Words:
    """Where the words of some texts stand in their bytes, so that all are hashed together, eight bytes at a time."""

    def __init__(self, texts):
        coded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b" ".join([*coded, bytes(8)])
        n = len(self.raw) - 8
        data = np.frombuffer(self.raw, np.uint8, n)
        blank = np.concatenate([[True], (data == 32) | (data - np.uint8(9) <= 4), [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.starts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        #: Words of each text.
        self.counts = np.diff(np.searchsorted(self.starts, np.cumsum([0, *(len(c) + 1 for c in coded)])))

    def hashes(self, seed: int = 0, which: np.ndarray | None = None) -> np.ndarray:
        """A hash of 64 bits of each word, or of those marked; of words of one length up to eight bytes no two are alike."""
        starts, sizes = (self.starts, self.sizes) if which is None else (self.starts[which], self.sizes[which])
        lanes = np.ndarray(len(self.raw) - 7, "<u8", self.raw, 0, (1,))
        out = splitmix(sizes.astype(np.uint64) + np.uint64(seed) * K1)
        todo = np.flatnonzero(sizes <= LONG_WORD)
        at, left = starts[todo], sizes[todo]
        while len(todo):
            lane = lanes[at]
            part = np.flatnonzero(left < 8)
            lane[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
            out[todo] = mixed(out[todo], lane)
            more = np.flatnonzero(left > 8)
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.raw[starts[i] : starts[i] + sizes[i]], seed)
        return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (a ^ (a >> np.uint64(31))) * K1
    x += b * K2
    x ^= x >> np.uint64(29)
    x *= K3
    x ^= x >> np.uint64(32)
    return x


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that start at each place; the last n - 1 places have none."""
    done: np.ndarray | None = None
    power, size, at = h, 1, 0
    while True:
        if n & size:
            part = power
            done = part if done is None else mixed(done[: len(part) - at] if len(done) > len(part) - at else done, part[at : at + len(done)])
            at += size
        size *= 2
        if size > n:
            return done[: max(0, len(h) - n + 1)]
        power = mixed(power[: max(0, len(power) - size // 2)], power[size // 2 :])


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + K1
    x = (x ^ (x >> np.uint64(30))) * K3
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
