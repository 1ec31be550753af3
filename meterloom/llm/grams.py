"""Vectorised hashing of words and of runs of units; used inside tasks only."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; a longer word is hashed in one go.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    have = _powers[base]
    if len(have) < n:
        grown = np.full(max(n, 1 << 12), np.uint64(base), np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= CHUNK + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of units[start:end] for each pair, equal for equal runs wherever they stand."""
    n = len(units)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(units * _power(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k units, in order."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        part = units[at : at + CHUNK + k - 1]
        m = len(part) - k + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        own = sums[k:] - sums[:-k]
        own *= _power(_INVERSE, m)
        own += np.uint64(k)
        out[at : at + m] = mix(own)
    return out


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a text given as bytes."""
    parts, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # a word is never cut
            spaces = np.flatnonzero(SPACE[raw[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                further = np.flatnonzero(SPACE[raw[end:]])
                end = end + int(further[0]) + 1 if len(further) else n
        part = raw[at:end]
        edge = np.diff(SPACE[part].view(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        parts.append((runs(part.astype(np.uint64) + np.uint64(1), starts, ends), starts + at, ends + at))
        at = end
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def shingles(raw: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of all words as one run if there are fewer."""
    own = words(raw)[0]
    if not len(own):
        return own
    return np.unique(grams(own, min(k, len(own))))
