"""Shingle sets and MinHash signatures of texts, for whole Arrow slices at a time."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Odd multipliers and finalisers of the hashes below (fixed values of well-known integer mixers).
R = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SEED = 20240818


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


#: A random number for each byte value.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(R), -1, 1 << 64))
    up, down = np.full(n, R), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n. Tables of 2**20 and 2**21 entries are kept."""
    size = 1 << max(20, (n - 1).bit_length())
    up, down = _powers(size) if size <= 1 << 21 else _powers.__wrapped__(n)
    return up[:n], down[:n]


def running_hash(data: np.ndarray) -> np.ndarray:
    """The n + 1 sums from which range_hash() takes the hash of any byte range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(len(data) + 1)[0][:-1], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end): the same for equal bytes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(running_hash(data), starts, ends)


#: Bytes of the longest word that is told by the running hash. Powers of one number modulo 2**64 tell short words apart, but
#: not long ones made to agree (a Thue-Morse word and its complement, from 1,024 letters on).
SHORT_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; long words by BLAKE2b of their bytes."""
    h = range_hashes(data, starts, ends)
    for i in np.flatnonzero(ends - starts > SHORT_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"word").digest())
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `words`-word shingles of each text as sorted 64-bit hashes, one after the other, and the
    n + 1 offsets of the texts. Words are runs of bytes other than space and \\x09-\\x0D with A-Z in lower case."""
    n = len(offsets) - 1
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = ~blank
    begins = inside[1:] & ~inside[:-1]
    stops = ~inside[1:] & inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    joined = edge[inside[edge] & inside[edge + 1]]  # words of two texts that touch
    begins[joined] = stops[joined] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    h = word_hashes(low, starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    values = np.zeros(len(h), np.uint64)
    for k in range(words):
        values[: len(h) - k] += mixed(h[k:] + np.uint64(k)) if k else mixed(h)
    keep = np.zeros(len(h), bool)
    full = np.arange(len(h)) + words <= first[owner + 1] if len(h) else keep
    keep |= full
    short = np.flatnonzero((count > 0) & (count < words))
    for t in short:  # the whole sequence is the one shingle
        part = h[first[t] : first[t + 1]]
        values[first[t]] = np.bitwise_xor.reduce(mixed(part + np.arange(7, 7 + len(part), dtype=np.uint64)))
        keep[first[t]] = True
    values, owner = mixed(values[keep]), owner[keep]
    parts, sizes = [], np.zeros(n + 1, np.int64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for t in range(n):
        if bounds[t] < bounds[t + 1]:
            parts.append(np.unique(values[bounds[t] : bounds[t + 1]]))
            sizes[t + 1] = len(parts[-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


def signatures(values: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """(texts x hashes) 16-bit MinHash values; of an empty set all zeros."""
    a, b = (np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, hashes), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, hashes), np.uint16)
    if len(full):
        for k in range(hashes):
            low = np.minimum.reduceat((values * a[k] + b[k]) >> np.uint64(16), offsets[:-1][full])
            out[full, k] = (mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def set_digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x 2) 64-bit digests of whole sets."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, 2), np.int64)
    if len(full):
        for k in range(2):
            out[full, k] = mixed(np.add.reduceat(mixed(values + np.uint64(k + 11)), offsets[:-1][full])).view(np.int64)
    return out
