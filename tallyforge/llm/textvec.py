"""Word hashes of many texts at once, straight from Arrow's UTF-8 buffers.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. A word's hash is a polynomial over random
64-bit values of its bytes, taken from prefix sums, and finished with a mixing function. Texts are cut into blocks of
a few MB, so that memory does not depend on how long a text is beyond 8 bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finisher of SplitMix64)."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1, and those of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, BLOCK + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(m, base, _U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins (one more number than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _hashes(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; heads: sorted places where a row begins, at which no word goes on."""
    n = len(data)
    word = ~_SEP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = heads[(heads > 0) & (heads < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power(n + 1)
    sums = np.cumsum(_VALUE[data] * up[:n], dtype=_U)
    before = np.where(starts > 0, sums[starts - 1], _U(0))
    return mix((sums[ends] - before) * down[starts]), starts


def word_hashes(column: pa.Array, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all rows in order, and where each row's begin (one more number than rows)."""
    data, at = utf8(column)
    n = len(at) - 1
    found, counts, row = [], np.zeros(n, np.int64), 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + block, "right")) - 1)
        lo, hi = at[row], at[end]
        if end > row + 1 or hi - lo <= 2 * block:
            h, s = _hashes(data[lo:hi], at[row:end] - lo)
            found.append(h)
            counts[row:end] = np.diff(np.searchsorted(s, at[row : end + 1] - lo))
        else:  # one long text: pieces end at white space
            while lo < hi:
                cut = min(hi, lo + block)
                while cut < hi:
                    gaps = np.flatnonzero(_SEP[data[lo:cut]])
                    if len(gaps):
                        cut = lo + int(gaps[-1]) + 1
                        break
                    cut = min(hi, cut + block)
                h, _ = _hashes(data[lo:cut], np.zeros(1, np.int64))
                found.append(h)
                counts[row] += len(h)
                lo = cut
        row = end
    return np.concatenate(found) if found else np.zeros(0, _U), np.concatenate([[0], np.cumsum(counts)])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The set of hashes of k consecutive words, sorted; fewer words are one shingle, none are the empty set."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    total = np.full(n - size + 1, size, _U)
    for i in range(size):
        total = mix(total ^ (words[i : n - size + 1 + i] * _U(2 * i + 0x9E3779B1)))
    return np.unique(total)
