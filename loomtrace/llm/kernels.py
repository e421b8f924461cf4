"""Vectorised text kernels on Arrow buffers: no Python object is made for a word or a shingle.

Hashes are 64-bit polynomial hashes over bytes (any odd base is invertible modulo 2**64, so the hash of a slice is
``(C[end] - C[start]) * base**-start`` of one running sum), finished with a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes that one vector step handles; bounds the memory of a kernel whatever a text's length.
SEGMENT = 1 << 19

_powers: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1024)
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash; a bijection."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def flat_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def table(word: str) -> np.ndarray:
    """Byte -> lower-cased byte, or 0 outside words.  ``word``: 'space' splits at white space, 'alnum' at ASCII but letters and digits."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    if word == "space":
        lut[[32, *range(9, 14)]] = 0
    else:
        lut[:48] = lut[58:65] = lut[91:97] = lut[123:128] = 0
    return lut


SPACE, ALNUM = table("space"), table("alnum")
#: In 'space' texts the byte 0 is a word's byte; it is hashed as this value.
ZERO = U(256)


def words(raw: np.ndarray, at: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and for each row the number of its first word (one more entry than rows)."""
    n = len(raw)
    starts, ends, hashes = [], [], []
    inner = at[(at > 0) & (at < n)]
    s = 0
    gap = np.ones(256, bool) if lut is None else lut == 0
    if lut is SPACE:
        gap = gap.copy()
        gap[0] = False
    while s < n:
        e = min(n, s + SEGMENT)
        if e < n:  # cut at a gap or at a row's start
            back = np.flatnonzero(gap[raw[s:e]])
            row = inner[np.searchsorted(inner, e, "right") - 1] if len(inner) and inner[0] <= e else 0
            cut = max(s + int(back[-1]) + 1 if len(back) else 0, int(row))
            if cut > s:
                e = cut
            else:  # one word longer than a segment
                later = inner[np.searchsorted(inner, e, "right") :]
                stop = int(later[0]) if len(later) else n
                more = np.flatnonzero(gap[raw[e:stop]])
                e = e + int(more[0]) + 1 if len(more) else stop
        part = raw[s:e]
        b = lut[part].astype(U)
        w = ~gap[part]
        if lut is SPACE:
            b[part == 0] = ZERO
        first = np.empty(e - s, bool)
        first[0] = True
        np.logical_not(w[:-1], out=first[1:])
        lo, hi = np.searchsorted(inner, (s, e))
        cuts = inner[lo:hi] - s
        first[cuts] = True
        first &= w
        last = np.empty(e - s, bool)
        last[-1] = True
        np.logical_not(w[1:], out=last[:-1])
        last[cuts[cuts > 0] - 1] = True
        last &= w
        i, j = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, q = powers(e - s + 1)
        c = np.zeros(e - s + 1, U)
        np.cumsum(b * p[:-1], out=c[1:])
        starts.append(i + s)
        ends.append(j + s)
        hashes.append(mix((c[j] - c[i]) * q[i]))
        s = e
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, U)
    return start, end, h, np.searchsorted(start, at)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each row, and each row's first shingle.  A row of fewer words, but not none, is one shingle."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=out_at[1:])
    if not len(h):
        return np.empty(0, U), out_at
    full = np.zeros(max(0, len(h) - k + 1), U)
    for i in range(k if len(full) else 0):
        full += mix(h[i : len(full) + i] + U((BASE * (i + 1)) & MASK)) * U(((2 * i + 1) * 0xC2B2AE3D27D4EB4F) & MASK)
    row = np.repeat(np.arange(len(n)), count)
    place = first[row] + np.arange(len(row)) - out_at[row]
    short = n[row] < k
    out = np.empty(len(row), U)
    out[~short] = mix(full[place[~short]])
    for at in np.flatnonzero(short):
        r = row[at]
        v = int(n[r]) * BASE
        for x in h[first[r] : first[r + 1]].tolist():
            v = ((v ^ x) * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & MASK
            v ^= v >> 29
        out[at] = v
    return out, out_at


def digest(sorted_hashes: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(sorted_hashes.tobytes(), digest_size=16).digest()
