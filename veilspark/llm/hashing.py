"""Vectorised 64-bit hashing of byte strings, words and shingles with numpy.

A window's hash is ``sum(c[i] * B**i)`` modulo 2**64, shifted to position 0 by the inverse power and mixed. One running
sum over a buffer thus gives the hash of any of its substrings in constant time.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; grows to the longest buffer seen."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of ``(c + 1) * B**i``; entry i covers the first i bytes."""
    powers, _ = power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the buffer behind ``sums``; equal contents have equal hashes anywhere."""
    _, inverse = power_table(len(sums))
    return mix64((sums[ends] - sums[starts]) * inverse[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes of texts that are hashed at a time, or one text: the running sums take eight times as many.
SLICE = 1 << 17


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the ``[^\\x20\\x09-\\x0D]+`` words of all texts with A-Z in lower case."""
    offsets, hashes, held, size = [np.zeros(1, np.int64)], [np.empty(0, np.uint64)], [], 0
    for i, text in enumerate(texts, 1):
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= SLICE or i == len(texts):
            at, found = _hashed(held)
            offsets.append(at + offsets[-1][-1])
            hashes.append(found)
            held, size = [], 0
    return np.concatenate(offsets), np.concatenate(hashes)


def _hashed(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words up to the end of each text, hashes)."""
    data = _LOWER[np.frombuffer(b" ".join([*coded, b""]), np.uint8)]
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    hashes = span_hashes(prefix_sums(data), starts, ends)
    # a document begins right after the separator of the one before
    return np.searchsorted(starts, np.cumsum([len(t) + 1 for t in coded])), hashes


_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def word_shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` words, sorted; of fewer words the whole sequence; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, width)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _FACTORS[j]
    return np.unique(mix64(total + np.uint64(k)))
