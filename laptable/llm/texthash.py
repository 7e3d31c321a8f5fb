"""Words, shingles and their 64-bit hashes for many texts at once, in numpy.

A word is a run of bytes other than the ASCII white space; A-Z count as a-z. A word's hash comes from prefix sums of random
byte values times powers of an odd number, so all words of a batch cost a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (shifts and odd multiplications)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


VALUES = numbers(256, 1)
VALUES[65:91] = VALUES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, remembered."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(size, base, U)
            row[0] = 1
            out.append(np.cumprod(row, dtype=U))
        _powers = out[0], out[1]
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the number of words before each text (and in all)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    edges, first = edges - edges[0], int(edges[0])
    if edges[-1] == 0:
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + int(edges[-1])]
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U))
    return hashes, np.searchsorted(start, edges)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words.

    A text with fewer words has one shingle, its whole sequence; without words the set is empty.
    """
    hashes, at = word_hashes(texts)
    rows = np.full(max(len(hashes) - words + 1, 0), words, U)
    for k in range(words):
        rows = mix(rows * U(BASE) + hashes[k : k + len(rows)])
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= words:
            yield np.unique(rows[a : b - words + 1])
        elif b > a:
            one = np.array([b - a], U)
            for k in range(a, b):
                one = mix(one * U(BASE) + hashes[k : k + 1])
            yield one
        else:
            yield np.zeros(0, U)
