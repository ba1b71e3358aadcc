"""Words and rolling windows of a text buffer as 64-bit hashes, all in numpy.

A word is a maximal run of bytes of one class; its hash is a polynomial over
randomised byte values modulo 2**64, mixed.  A window's hash is a polynomial
over its words' hashes, so every rolling window costs a few vector steps.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(16)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.empty(n, U64)
        p[0] = 1
        m = 1
        while m < n:  # doubling: p[m:2m] = p[:m] * b**m
            k = min(m, n - m)
            p[m : m + k] = p[:k] * U64(pow(b, m, 1 << 64))
            m += k
        p.setflags(write=False)
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    size = 1 << 16
    while size < n:
        size *= 2
    p, q = _powers(base, size)
    return p[:n], q[:n]


@lru_cache(8)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: Bases of the two independent hash families.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(4)
def space_table() -> np.ndarray:
    """True for bytes of a word: all but space and 0x09-0x0D."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


@lru_cache(4)
def letter_table() -> np.ndarray:
    """True for ASCII letters and digits and every byte of a non-ASCII character."""
    t = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[a:b] = True
    return t


@lru_cache(4)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (n+1 values)."""
    inside = member[buf]
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    prev = np.empty(n, bool)
    if n:
        prev[0] = False
        prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | cut[:n]))
    nxt = np.empty(n, bool)
    if n:
        nxt[-1] = False
        nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    base = BASES[family]
    p, q = powers(base, len(buf) + 1)
    acc = np.zeros(len(buf) + 1, U64)
    np.cumsum(_byte_values(family)[buf] * p[: len(buf)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each position (n-k+1 values); rows aren't told apart here."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    p, q = powers(BASES[family] ^ 0x5A5A5A5A5A5A5A5A | 1, n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum(words * p[:n], out=acc[1:])
    return mix((acc[k:] - acc[:-k]) * q[: n - k + 1])


def window_valid(first: np.ndarray, k: int) -> np.ndarray:
    """For each window start (n-k+1 of them): does it end in the row it starts in?"""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    bad = np.zeros(n + 1, np.int32)  # starts in [end-k+1, end) of a row cross its end
    lo = np.maximum(first[1:] - (k - 1), first[:-1])
    np.add.at(bad, lo, 1)
    np.add.at(bad, first[1:], -1)
    return np.cumsum(bad)[: n - k + 1] == 0


@lru_cache(4)
def token_classes() -> np.ndarray:
    """0 for white space, 1 for letters and digits, 2 for everything else."""
    t = np.where(letter_table(), 1, 2).astype(np.uint8)
    t[~space_table()] = 0
    return t


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``spans``, with runs of letters and runs of marks as tokens of their own."""
    kind = token_classes()[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    if n > 1:
        edge[1:n] |= kind[1:] != kind[:-1]
    inside = kind != 0
    starts = np.flatnonzero(inside & edge[:n])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows without values get zeros."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=np.float64)
    return out
