"""Vectorised hashing of word shingles: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import encoding, workers

SHINGLE = 5
#: Fixed odd multipliers and byte values of the hash, from a seeded generator.
_RNG = np.random.default_rng(20260101)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_VALUE = _BYTE[_SMALL]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in turn, number of words of each text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    blank = _BLANK[data]
    # every word has a start and, as the data end with a blank, an end
    change = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    starts, ends = change[0::2], change[1::2]
    power, back = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power, out=total[1:])
    words = (total[ends] - total[starts]) * back[starts]
    words = mix(words + (ends - starts).astype(np.uint64) * _STEP)
    counts = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(sizes)]))
    return words, counts


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text is one shingle."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        weight = np.uint64(1)
        for back in range(size - 1, -1, -1):
            rolled[: len(words) - back] += words[back:] * weight
            weight *= _STEP
        rolled = mix(rolled)
        out = []
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= size:
                s = np.sort(rolled[end - n : end - size + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif n:
                h = np.uint64(n)
                for w in words[end - n : end]:
                    h = mix(np.array([h * _STEP + w]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_hash(tokens: np.ndarray) -> int:
    """One signed 64-bit value for a set."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(tokens ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(tokens)) * _BASE]))
    return int(h.view(np.int64)[0])


def of_column(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its shingle set) of a string column."""
    for at, part in encoding.slices(column, most):
        for k, tokens in enumerate(shingle_sets([t or b"" for t in part.cast(pa.binary()).to_pylist()])):
            yield at + k, tokens
