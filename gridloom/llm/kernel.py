"""Array kernels over UTF-8 bytes of Arrow string columns.

A batch's text buffer is cut into groups of whole documents of at most GROUP bytes (one longer document is a group
of its own, hashed in segments cut between words), so that memory follows the group and never the batch squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are what is between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII letters, digits and whatever is beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, GROUP + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls are empty."""
    if pa.types.is_string(column.type):
        wide = np.int32
    elif pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        return utf8(column.cast(pa.large_string()))
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide, n + 1, column.offset * wide().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw, at = raw[at[0] : at[-1]], at - at[0]
    if column.null_count:
        size = np.diff(at)
        missing = np.asarray(column.is_null())
        if size[missing].any():  # bytes under a null do not count
            keep = np.repeat(~missing, size)
            size = np.where(missing, 0, size)
            raw, at = raw[keep], np.concatenate([[0], np.cumsum(size)])
    return raw, at


def groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Document ranges [i, j) of at most GROUP bytes, or one longer document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + GROUP, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_words(low: np.ndarray, word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a short buffer; no word crosses a cut."""
    n = len(low)
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = word[0], word[n - 1]
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    inner = np.unique(cuts[(cuts > 0) & (cuts < n)])
    both = inner[word[inner] & word[inner - 1]]  # a word ends and another starts here
    marks = np.flatnonzero(edge)
    if len(both):
        marks = np.sort(np.concatenate([marks, both, both]))
    starts, ends = marks[0::2], marks[1::2]
    up, down = _pow(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[low] * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * _MUL)
    return starts, ends, h


def words(raw: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of documents: i, j, word starts and ends (in raw), 64-bit word hashes, and the word's document less i."""
    for i, j in groups(at):
        lo, hi = int(at[i]), int(at[j])
        if hi == lo:
            empty = np.zeros(0, np.int64)
            yield i, j, empty, empty, np.zeros(0, np.uint64), empty
            continue
        parts = []
        a = lo
        while a < hi:
            b = hi
            if j == i + 1 and hi - a > 2 * GROUP:  # cut a long document between words, else let the segment grow
                b, step = a + GROUP, GROUP
                while b < hi:
                    gap = np.flatnonzero(~table[LOWER[raw[b : b + step]] if lower else raw[b : b + step]])
                    if len(gap):
                        b += int(gap[0])
                        break
                    b += step
                b = min(b, hi)
            low = LOWER[raw[a:b]] if lower else raw[a:b]
            s, e, h = _hash_words(low, table[low], at[i : j + 1] - a)
            parts.append((s + a, e + a, h))
            a = b
        s, e, h = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
        yield i, j, s, e, h, np.searchsorted(at[i : j + 1], s, "right") - 1


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, in order; the caller masks those that cross documents."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k) * _MUL)
        m = 1
        for x in range(k):
            m = (m * 0x2545F4914F6CDD1D + 0x1234567) % (1 << 64) | 1
            out += h[x : len(h) - k + 1 + x] * np.uint64(m)
        return mix(out)
