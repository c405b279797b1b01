"""Hashes of any slice of a byte or word array, vectorised: two polynomials with seeded bases over the field of 2^31 - 1.

They only tell where to look. Whatever the operators remove is compared on its bytes or words.
"""

from __future__ import annotations

import numpy as np

PRIME = np.uint64((1 << 31) - 1)
_rng = np.random.default_rng(20240517)
BASES = tuple(int(x) for x in _rng.integers(1 << 20, (1 << 31) - 2, 2))
BYTE_VALUE = _rng.integers(1, 1 << 62, 256, dtype=np.uint64)
_BYTE_LOW, _BYTE_HIGH = (BYTE_VALUE % PRIME).astype(np.uint32), ((BYTE_VALUE >> np.uint64(17)) % PRIME).astype(np.uint32)
_tables: dict[int, np.ndarray] = {}


#: Elements that one step works on: they stay in the processor's cache.
STEP = 1 << 15


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, for x below 2^62."""
    high = x >> np.uint64(31)
    x = x & PRIME
    x += high
    np.right_shift(x, np.uint64(31), out=high)
    x &= PRIME
    x += high
    np.subtract(x, PRIME, out=x, where=x >= PRIME)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have.astype(np.uint64)
        size = 1 << max(n - 1, (1 << 16) - 1).bit_length()
        while len(have) < size:  # the powers known so far, times the next one
            have = np.concatenate([have, _reduce(have * np.uint64(pow(base, len(have), int(PRIME))))])
        have = have.astype(np.uint32)
        _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every bit over all others (the constants are those of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hash of values[a:b] for arrays a and b. values: one array for each base, below the prime; names of any 64 bits go through ``of_names``."""

    def __init__(self, values: tuple[np.ndarray, np.ndarray]):
        self.n = len(values[0])
        self.sums = []
        for base, v in zip(BASES, values):
            total, power = np.zeros(self.n + 1, np.uint64), _powers(base, self.n)
            for i in range(0, self.n, STEP):
                part = total[i + 1 : i + 1 + STEP]
                np.cumsum(_reduce(v[i : i + STEP].astype(np.uint64) * power[i : i + STEP]), out=part)
                part += total[i]
            self.sums.append(total)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint64)
        inverse = [_powers(pow(base, -1, int(PRIME)), self.n + 1) for base in BASES]
        for i in range(0, len(a), STEP):
            x, y, h = a[i : i + STEP], b[i : i + STEP], out[i : i + STEP]
            for power, total in zip(inverse, self.sums):
                h <<= np.uint64(32)
                h |= _reduce(_reduce(total[y] - total[x]) * power[x])
            with np.errstate(over="ignore"):
                h += (y - x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h[:] = mix(h)
        return out


def of_names(names: np.ndarray) -> Rolling:
    return Rolling((_reduce(names & np.uint64((1 << 62) - 1)), _reduce(names >> np.uint64(17))))


def of_bytes(raw: np.ndarray) -> Rolling:
    return Rolling((_BYTE_LOW[raw], _BYTE_HIGH[raw]))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros behind the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), "<u8", padded, strides=(1,))


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` bytes: hashes of halves are mixed, the last two halves may overlap."""
    n = max(len(raw) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    wide = eights(raw)
    for i in range(0, n, STEP):
        if size >= 8:
            have, length = mix(wide[i : i + STEP + size - 8].copy()), 8
        else:
            have, length = BYTE_VALUE[raw[i : i + STEP + size - 1]], 1
        with np.errstate(over="ignore"):
            while length * 2 <= size:
                have = mix(have[: len(have) - length] * np.uint64(0x9E3779B97F4A7C15) + have[length:])
                length *= 2
            if length < size:
                rest = size - length
                have = mix(have[: len(have) - rest] * np.uint64(0xC2B2AE3D27D4EB4F) + have[rest:])
        out[i : i + STEP] = have[: n - i]
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in a buffer, and how many each text has; words never cross texts."""
    n = len(raw)
    solid = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.concatenate([solid[1:], [False]]) if n else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def squeezed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every run of white space made one space, and their new offsets."""
    space = SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = np.where(space, np.uint8(0x20), raw)[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[at]


def spans_of_counts(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n))).astype(np.int64)
