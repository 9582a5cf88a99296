"""Words of many texts as arrays: ids, hashes, hashes of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from . import common

#: Odd multipliers of the hash of a sequence.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Distinct words that a worker remembers, and texts and words that are looked at together.
REMEMBERED, TOGETHER = 300_000, 500_000


class Hashes(dict):
    """The 64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class Ids(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, by doubling."""
    out, done, part, size = None, 0, hashes, 1
    while True:
        if k & size:
            n = len(hashes) - done - size + 1
            out = part[:n] if out is None else mixed(out[:n]) + part[done : done + n]
            done += size
            if done == k:
                return mixed(out)
        part = mixed(part[:-size]) + part[size:]
        size *= 2


def lows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def hashed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """For runs of rows: the words of each text of ``column``, all their hashes, the texts' numbers of words, and the rows."""
    common.trim()
    get = Hashes()
    for batch in batches:
        texts: list[list[bytes]] = []
        first = n = 0
        for i, text in enumerate(batch.column(column)):
            texts.append(text.as_py().encode().split())
            n += len(texts[-1])
            if n >= TOGETHER or i + 1 == batch.num_rows:
                hashes = np.fromiter((get[w] for t in texts for w in t), np.uint64, n)
                yield texts, hashes, np.array([len(t) for t in texts], np.int64), batch.slice(first, len(texts))
                texts, first, n = [], i + 1, 0
