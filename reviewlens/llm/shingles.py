"""Vectorised hashing of word shingles for a whole Arrow batch of texts.

Words are the maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` after
lower-casing A-Z, so UTF-8 text needs no decoding. Every word is hashed from
its bytes with a polynomial over the ring of 64-bit integers whose
coefficients are random per byte value; a shingle hash mixes the hashes of
its words in order. All arithmetic runs over the flat byte buffer of a batch,
never per word in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
#: odd multipliers of the byte polynomial and of the word polynomial
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
#: bytes hashed at once, so that a batch of very long texts stays small in memory
CHUNK_BYTES = 1 << 20

_space = np.zeros(256, dtype=bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_byte_key = np.random.Generator(np.random.PCG64(20240607)).integers(
    1, 1 << 63, 256, dtype=np.uint64)
_byte_key[65:91] = _byte_key[97:123]        # A-Z hash like a-z


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_pow_cache: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; at most one table of CHUNK size is kept."""
    have = _pow_cache.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    table = _powers(base, max(n, 1 << 16))
    if n <= 2 * CHUNK_BYTES:
        _pow_cache[base] = table
    return table[:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and row offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows of about ``size`` bytes, at least one row each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row, first byte, byte after each word)."""
    n = len(raw)
    rows = len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64), none, none
    word = ~_space[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]              # a row starts a word of its own
    begin = np.flatnonzero(start)
    # a word ends before white space, before a row start or at the end
    stop = ~word
    stop[first] = True
    stops = np.append(np.flatnonzero(stop), n)
    end = stops[np.searchsorted(stops, begin + 1)]
    key = _byte_key[raw]
    key *= _pow(_P, n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(key, out=sums[1:])
    h = (sums[end] - sums[begin]) * _pow(_P_INV, n)[begin]
    counts = np.searchsorted(begin, offsets[1:]) - np.searchsorted(begin, offsets[:-1])
    return mix64(h + (end - begin).astype(np.uint64)), counts, begin, end


def shingle_hashes(w: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and words per row -> (hash of every k-word shingle, shingles per row).

    A row of 1 to k - 1 words has one shingle, the whole sequence; a row
    without words has none. Repeats inside a row are kept.
    """
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not len(w):
        return np.zeros(0, np.uint64), n_sh
    first = np.cumsum(counts) - counts
    m = len(w)
    out = np.zeros(m, dtype=np.uint64)
    q = 1
    for j in range(k):
        out[:m - j] += w[j:] * np.uint64(q) if j < m else 0
        q = q * _Q & _MASK
    # the last k - 1 words of a row start no full shingle
    pos = np.arange(m) - np.repeat(first, counts)
    keep = pos < np.repeat(n_sh, counts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:                          # few words: hash them alone
        acc, q = 0, 1
        for x in w[first[r]:first[r] + counts[r]].tolist():
            acc = (acc + x * q) & _MASK
            q = q * _Q & _MASK
        out[first[r]] = (acc + int(counts[r]) * 0x632BE59BD9B4E019) & _MASK
    return mix64(out[keep]), n_sh


def batch_shingles(col: pa.Array, k: int, size: int = CHUNK_BYTES):
    """Yield (row, hashes with repeats) for every row of a text column."""
    raw, offsets = text_buffers(col)
    for a, b in row_chunks(offsets, size):
        part = raw[offsets[a]:offsets[b]]
        w, counts, _, _ = word_hashes(part, offsets[a:b + 1] - offsets[a])
        h, n_sh = shingle_hashes(w, counts, k)
        ends = np.cumsum(n_sh)
        for r in range(a, b):
            e = ends[r - a]
            yield r, h[e - n_sh[r - a]:e]
