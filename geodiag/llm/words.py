"""Vectorised word scanning over whole Arrow string buffers.

Texts are handled as one byte buffer with document offsets. Separators are ASCII, so
byte-level scanning of UTF-8 is exact. A word's 64-bit hash comes from prefix sums of a
tabulated polynomial modulo 2**64; there is no loop over words or documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_TAB = _rng.integers(1, 2**64, 256, dtype=U64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TAB_LOWER = _TAB[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []

#: bytes of words `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: bytes of text handled at a time
CHUNK = 1 << 21
_BLOCK = 1 << 19


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each maximal run of bytes in ``inside``; runs don't cross documents."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[buf]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    cuts = off[:-1]
    before[cuts[cuts < len(buf)]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    ends = off[1:]
    after[ends[ends > 0] - 1] = False
    stops = np.flatnonzero(w & ~after) + 1
    return starts, stops, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 1)
        made = []
        for b in (_BASE, _INV):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * _BLOCK:  # a giant word: not kept
            return made
        _powers[:] = made
    return _powers


def hash_spans(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span; with ``fold`` A-Z counts as a-z. Spans are in order and don't overlap."""
    out = np.empty(len(starts), U64)
    tab = _TAB_LOWER if fold else _TAB
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(stops, a + _BLOCK, "right")))
        b = int(stops[j - 1])
        pw, inv = _power_tables(b - a + 1)
        p = np.zeros(b - a + 1, U64)
        np.cumsum(tab[buf[a:b]] * pw[: b - a], out=p[1:])
        s, e = starts[i:j] - a, stops[i:j] - a
        out[i:j] = (p[e] - p[s]) * inv[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of ``k`` consecutive words and their documents. ``whole``: fewer words give one hash of all of them."""
    counts = np.bincount(doc, minlength=n_docs)
    x = np.zeros(max(len(h) - k + 1, 0), U64)
    for i in range(k):
        x = mix(x * U64(3) + h[i : i + len(x)] + U64(0x9E3779B97F4A7C15))
    ok = doc[: len(x)] == doc[k - 1 :][: len(x)]
    x, d = x[ok], doc[: len(ok)][ok]
    if whole and len(short := np.flatnonzero((counts > 0) & (counts < k))):
        first = np.concatenate([[0], np.cumsum(counts)])
        more = np.array([mix(h[first[i] : first[i + 1]] * (U64(2) * np.arange(counts[i], dtype=U64) + U64(1))).sum(dtype=U64) ^ U64(counts[i]) for i in short], U64)
        x, d = np.concatenate([x, more]), np.concatenate([d, short])
    return x, d
