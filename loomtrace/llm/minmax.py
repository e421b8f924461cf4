"""Min-max hashing: signatures, bands and exact likeness of shingle sets (numpy only)."""

from __future__ import annotations

import numpy as np

from . import kernels

#: Words of a shingle where no other number is given.
SHINGLE = 3
#: Hash functions; each gives a minimum and a maximum, so a signature has twice as many values.
FUNCTIONS = 48
#: Values of a band; FUNCTIONS * 2 / ROWS bands.
ROWS = 4
BANDS = FUNCTIONS * 2 // ROWS


def constants(n: int = FUNCTIONS) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return kernels.mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), kernels.mix(i * np.uint64(0xC2B2AE3D27D4EB4F))


MUL, ADD = constants()


def sets(raw: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, ascending, and each row's first."""
    _, _, h, first = kernels.words(raw, at, kernels.SPACE)
    s, s_at = kernels.shingles(h, first, k)
    out, count = [], np.zeros(len(at), np.int64)
    for r in range(len(at) - 1):
        u = np.unique(s[s_at[r] : s_at[r + 1]])
        out.append(u)
        count[r + 1] = len(u)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(count)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """2 * FUNCTIONS values for every row that is not empty: the minimum and the maximum under each function."""
    out = np.empty((len(at) - 1, 2 * FUNCTIONS), np.uint64)
    for f in range(FUNCTIONS):
        x = values * MUL[f] + ADD[f]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, f] = np.minimum.reduceat(x, at[:-1])
        out[:, FUNCTIONS + f] = np.maximum.reduceat(x, at[:-1])
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band.  A function's minimum and maximum fall into different bands."""
    out = np.empty((len(signature), BANDS), np.uint64)
    half = BANDS // 2
    for b in range(BANDS):
        base, side = (b % half) * ROWS, FUNCTIONS * (b // half)
        v = np.full(len(signature), kernels.U((b + 1) * 0x9E3779B97F4A7C15 & kernels.MASK), np.uint64)
        for r in range(ROWS):
            v = kernels.mix(v ^ signature[:, side + base + r])
        out[:, b] = v
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int(np.count_nonzero(b[i] == a))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    least, most = sorted((len(a), len(b)))
    if not least or 100 * least < percent * most:
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Rarest:
    """Rows by the rarest of their shingles.  A linked pair has at least percent of either set in common, so if both sets are
    in one order, their first ``size - percent of size + 1`` shingles have one in common, whatever the order."""

    def __init__(self, values: np.ndarray, at: np.ndarray, percent: int):
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        _, kind, times = np.unique(values, return_inverse=True, return_counts=True)
        order = np.lexsort((kind, times[kind], row))
        first = np.arange(len(values)) - at[row] < (n + (-percent * n) // 100 + 1)[row]
        self.kind, self.row = kind[order][first], row[first]
        self.at = np.searchsorted(self.row, np.arange(len(n) + 1))
        by = np.argsort(self.kind, kind="stable")
        self.rows, self.first = self.row[by], np.searchsorted(self.kind[by], np.arange(len(times) + 1))

    def meets(self, x: int) -> np.ndarray:
        """Of each row, whether one of its rarest shingles is one of row x's."""
        out = np.zeros(len(self.at) - 1, bool)
        for k in self.kind[self.at[x] : self.at[x + 1]].tolist():
            out[self.rows[self.first[k] : self.first[k + 1]]] = True
        return out
