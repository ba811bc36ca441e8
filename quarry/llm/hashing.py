"""Vectorised hashes of words and word windows straight from Arrow's UTF-8 buffers.

A word's hash is a polynomial over its bytes taken from one running sum per block, so no Python
object is made for a word. Blocks are cut at whitespace, so memory follows the block, not the text. Since different long
texts with equal polynomials modulo 2^64 can be constructed (from 1,024 bytes on), words of LONG bytes or more are hashed by BLAKE2 instead.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

LONG = 512
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 20
_U = np.uint64

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        for key, base in (("p", _P), ("i", _PINV)):
            x = np.full(n, base, _U)
            x[0] = 1
            _tables[key] = np.multiply.accumulate(x)
    return _tables["p"], _tables["i"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and per text the index of its first word (one more at the end)."""
    hashes, starts = [], []
    begin, end = 0, len(raw)
    while begin < end:
        stop = min(end, begin + _BLOCK)
        if stop < end:  # go back to a blank or the start of a text, or on to the next
            tail = np.flatnonzero(_IS_BLANK[raw[begin:stop]])
            text = offsets[np.searchsorted(offsets, stop, "right") - 1]
            back = max(int(text), begin + int(tail[-1]) + 1 if len(tail) else 0)
            if back <= begin:
                back = int(offsets[np.searchsorted(offsets, begin, "right")])
                for at in range(stop, back, _BLOCK):
                    near = np.flatnonzero(_IS_BLANK[raw[at : min(back, at + _BLOCK)]])
                    if len(near):
                        back = at + int(near[0]) + 1
                        break
            stop = back
        part = _LOWER[raw[begin:stop]]
        solid = ~_IS_BLANK[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[0] = True
        edge[offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, stop, "right")] - begin] = True
        left = solid.copy()
        left[1:] &= ~solid[:-1] | edge[1:-1]
        right = solid.copy()
        right[:-1] &= ~solid[1:] | edge[1:-1]
        s, e = np.flatnonzero(left), np.flatnonzero(right) + 1
        powers, inverse = _powers(max(_BLOCK, len(part)))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * powers[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        for i in np.flatnonzero(e - s >= LONG):
            h[i] = int.from_bytes(blake2b(part[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(mix(h ^ ((e - s).astype(_U) * _U(0xD6E8FEB86659FD93))))
        starts.append(s + begin)
        begin = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets, "left")


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and per text the index of its first; a shorter text is one window."""
    counts = np.diff(first)
    n = len(words)
    acc = np.zeros(max(0, n - k + 1), _U)
    for j in range(k):
        acc = acc * _U(_P) + words[j : n - k + 1 + j] if len(acc) else acc
    acc = mix(acc)
    out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(out)])
    res = np.empty(at[-1], _U)
    long = np.flatnonzero(counts >= k)
    if len(long):
        sizes = out[long]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        res[np.repeat(at[long], sizes) + within] = acc[np.repeat(first[long], sizes) + within]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = _U(counts[i])
        w = words[first[i] : first[i + 1]]
        acc1 = np.array([x], _U)
        for j in range(len(w)):
            acc1 = acc1 * _U(_P) + w[j : j + 1]
        res[at[i]] = mix(acc1 ^ _U(0xA5A5A5A5A5A5A5A5))[0]
    return res, at


def spans(offsets: np.ndarray, most: int = 1 << 22):
    """Consecutive ranges of texts with about so many bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
