"""Vectorised byte work on Arrow batches of texts: blocks of bounded size, words, hashes.

All functions run inside tasks, on the rows that Spark hands them. A block holds whole texts; memory is bounded by the
block limit or by the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Texts of a block at most; ``distinct_per_row`` numbers them in 12 bits.
BLOCK_ROWS = 1 << 12

#: Words ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, 2 * len(_POWERS["up"]))
        for key, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


class Block:
    """Texts side by side in one buffer, a space behind each. A null text is empty."""

    def __init__(self, rows: pa.RecordBatch, texts: list[bytes]):
        self.rows = rows
        self.texts = texts
        self.raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.lengths = lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])

    def __len__(self) -> int:
        return len(self.texts)

    def lower(self) -> np.ndarray:
        return LOWER[self.raw]

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and keeps what it once held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
        start = total = 0
        for i, text in enumerate(texts):
            if i > start and (total + len(text) > limit or i - start >= BLOCK_ROWS):
                yield Block(batch.slice(start, i - start), texts[start:i])
                start, total = i, 0
            total += len(text)
        if texts:
            yield Block(batch.slice(start), texts[start:])
    release()


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending starts lie in each text."""
    return np.diff(np.searchsorted(starts, offsets))


def words(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class Hasher:
    """64-bit hashes of any pieces of a buffer, in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k following words, and the text of each; a text of fewer words gives one of all its words.

    hashes: word hashes in order; counts: words in each text.
    """
    n, rows = len(hashes), np.repeat(np.arange(len(counts)), counts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_ODD) + hashes[j : n - k + 1 + j]) if len(out) else out
    whole = rows[: len(out)] == rows[k - 1 :]
    out, owner = out[whole], rows[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = (np.cumsum(counts) - counts)[short]
        sums = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            sums[has] = mix(sums[has] * np.uint64(_ODD) + hashes[first[has] + j] + np.uint64(j + 1))
        out, owner = np.concatenate([out, mix(sums + counts[short].astype(np.uint64))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct_per_row(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, cut to their first 52 bits; the row of each; how often it occurs there."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(52) | values >> np.uint64(12))
    new = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    keys, runs = keys[new], np.diff(np.append(new, len(keys)))
    return keys & np.uint64((1 << 52) - 1), (keys >> np.uint64(52)).astype(np.int64), runs


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: for each row the bytes of its share of the values, in order."""
    raw = np.ascontiguousarray(values).tobytes()
    width = values.dtype.itemsize
    ends = np.concatenate([[0], np.cumsum(counts)]) * width
    return pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
