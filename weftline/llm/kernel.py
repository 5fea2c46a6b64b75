"""Vectorised text kernels: word and shingle hashes of whole Arrow string columns in numpy.

Texts are handled in pieces of about a megabyte, cut at separators, so memory does not grow with a batch
or with one very long text (which costs eight bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
#: ASCII that is neither letter nor digit; bytes of non-ASCII characters belong to words.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _TABLES or len(_TABLES["p"]) < n:
        n = max(n, PIECE + 65536)
        for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _TABLES[key] = np.cumprod(t, dtype=np.uint64)
    return _TABLES["p"], _TABLES["q"]


def hash_tokens(b: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the runs of bytes in b that are not separators."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep[b], [True])).view(np.int8)))
    s, e = edge[0::2], edge[1::2]
    p, q = _powers(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=h[1:])
    return mix((h[e] - h[s]) * q[s]), s


def _pieces(d: np.ndarray, sep: np.ndarray) -> Iterator[np.ndarray]:
    a, n = 0, len(d)
    while a < n:
        b = min(a + PIECE, n)
        while b < n and not sep[d[b]]:
            hit = np.flatnonzero(sep[d[b : b + 65536]])
            b = b + int(hit[0]) if len(hit) else min(b + 65536, n)
        yield d[a:b]
        a = b


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    col = pc.fill_null(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunked(col: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes with a space after each row, where rows start); a long row comes alone."""
    data, off = text_bytes(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
        rel = off[i : j + 1] - off[i]
        d = data[off[i] : off[j]]
        yield i, j, np.insert(d, rel[1:], 32), rel[:-1] + np.arange(j - i)
        i = j


def word_hashes(col: pa.Array, sep: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, their hashes in order), by chunks of rows; A-Z are lower-cased."""
    for i, j, b, starts in chunked(col):
        b = LOWER[b]
        if len(b) > PIECE + (j - i) and j == i + 1:
            h = np.concatenate([hash_tokens(x, sep)[0] for x in _pieces(b, sep)])
            yield i, np.array([len(h)]), h
        else:
            h, at = hash_tokens(b, sep)
            yield i, np.diff(np.append(np.searchsorted(at, starts), len(at))), h


def shingles(counts: np.ndarray, words: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each row, hashes of its runs of k words in order); short: fewer than k words make one shingle."""
    n = len(words)
    out = np.where(counts >= k, counts - k + 1, (counts > 0) & short)
    res = np.empty(int(out.sum()), np.uint64)
    row = np.repeat(np.arange(len(counts)), out)
    full = counts[row] >= k
    if n >= k and full.any():
        doc = np.repeat(np.arange(len(counts)), counts)
        h = words[: n - k + 1].copy()
        for j in range(1, k):
            h = mix(h + np.uint64(j)) + words[j : n - k + 1 + j]
        res[full] = mix(h)[doc[: n - k + 1] == doc[k - 1 :]]
    if not full.all():
        first = np.cumsum(counts) - counts
        at = np.cumsum(out) - out
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            h = words[first[r] : first[r] + 1].copy()
            for j in range(1, int(counts[r])):
                h = mix(h + np.uint64(j)) + words[first[r] + j : first[r] + j + 1]
            res[at[r]] = mix(h ^ np.uint64(0x5851F42D4C957F2D + int(counts[r])))[0]
    return out, res


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P) + np.uint64(seed)) | np.uint64(1)


def minima(counts: np.ndarray, hashes: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """MinHash values, one row of len(mult) for each row with hashes; rows without any are zero."""
    out = np.zeros((len(counts), len(mult)), np.uint64)
    live = counts > 0
    if live.any():
        at = (np.cumsum(counts) - counts)[live]
        for i, m in enumerate(mult):
            out[live, i] = np.minimum.reduceat(hashes * m, at)
    return out
