"""Whole-batch text kernels on UTF-8 bytes.

Each kernel takes the bytes of many texts and their offsets, so that the work
per text is a handful of array operations, whatever the text's length.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240917)
#: A 64-bit value for each byte, and the odd base of the rolling word hash.
_BYTE_VALUE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 20)
        got = np.full(size, np.uint64(base))
        got[0] = 1
        _powers[base] = got = np.multiply.accumulate(got)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, wordlike: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each text's words.

    Words are runs without ASCII white space, or with ``wordlike`` runs of
    ASCII letters, digits and non-ASCII bytes.
    """
    inside = _WORDLIKE[data] if wordlike else ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, latin: bool = False) -> np.ndarray:
    """A 64-bit hash of each word in lower case: A-Z, with ``latin`` also the capitals of Latin-1."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lower = _LOWER[data]
    if latin and len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower[1:][capital] += 32
    rolled = np.empty(len(data) + 1, np.uint64)
    rolled[0] = 0
    np.cumsum(_BYTE_VALUE[lower] * _powers_of(_BASE, len(data)), out=rolled[1:])
    return mix((rolled[ends] - rolled[starts]) * _powers_of(_UNBASE, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``n`` consecutive words; a shorter text has its whole sequence as one, an empty one none."""
    salt = [np.uint64(pow(_BASE, k + 2, 2**64) | 1) for k in range(n)]
    full = np.zeros(0, np.uint64)
    if len(words) >= n:
        full = words[: len(words) - n + 1] * salt[0]
        for k in range(1, n):
            full = full + words[k : len(words) - n + 1 + k] * salt[k]
        full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            own = np.sort(full[a : b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            h = np.uint64(b - a)
            for k in range(b - a):
                h = h + words[a + k : a + k + 1] * salt[k]
            out.append(mix(h ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(full[:0])
    return out


_SEEDS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def minhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` minima of one set under fixed 32-bit permutations."""
    if size not in _SEEDS:
        rng = np.random.default_rng(size * 7919 + 1)
        _SEEDS[size] = (rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, size, dtype=np.uint32))
    times, flip = _SEEDS[size]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = None
    for a in range(0, len(low), 2048):
        part = low[None, a : a + 2048] ^ flip[:, None]
        part *= times[:, None]
        part ^= part >> np.uint32(15)
        now = part.min(axis=1)
        least = now if least is None else np.minimum(least, now)
    return least
