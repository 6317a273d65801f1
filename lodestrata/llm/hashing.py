"""64-bit hashes of words and of windows of words or bytes, vectorised over batches of texts.

A word's hash is a polynomial in random byte values modulo 2**64, mixed; a window's is a sum of its items' hashes times
random odd numbers, mixed. Both are functions of the content alone, alike on every machine and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=U)
COEFFICIENTS = _RNG.integers(0, 2**64, 512, dtype=U) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
CHUNK_BYTES = 2 << 20
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; x may be overwritten."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(m, U(base % 2**64))
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(SEPARATORS[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U))


def window_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive items."""
    m = len(items) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = np.zeros(m, U)
    for j in range(n):
        total += items[j : j + m] * COEFFICIENTS[j]
    return mix(total)


def batches_of(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and the texts' offsets with the end."""
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8), offsets


def split_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, starts, ends of the words, their hashes, and the index of each text's first word, with the end."""
    data, offsets = joined(texts)
    starts, ends = word_spans(data)
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def trimmed() -> None:
    """Gives memory that is free back to the system, since Python workers live on beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
