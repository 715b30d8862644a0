"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Constants of the splitmix64 finaliser (fixed values).
MIX_ADD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A seeded 64-bit mixing of an unsigned array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * MIX_ADD + MIX_ADD) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back when it is done."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


class WordHash(dict):
    """Word to 64-bit hash, each distinct word hashed once; emptied when it would outgrow its bound."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of `size` entries of `h` (at least `size` long)."""
    n = len(h) - size + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out *= np.uint64(MIX_ADD)
            out ^= out >> np.uint64(29)
            out += h[k : k + n]
    return mix64(out)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = 500_000, most_rows: int = 2000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut into runs of about `most_chars` characters, with the text column as a list.

    A longer text makes a run of its own; texts are never cut.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        lengths = np.nan_to_num(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > most_chars or i - start >= most_rows):
                part = batch.slice(start, i - start)
                yield part, part.column(part.schema.get_field_index(text)).to_pylist()
                start, size = i, 0
            size += n
        part = batch.slice(start)
        yield part, part.column(part.schema.get_field_index(text)).to_pylist()
