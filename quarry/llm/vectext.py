"""Vectorised hashing of words and word shingles over Arrow batches of texts.

A word is a maximal run of bytes outside ASCII white space, with A-Z lower-cased.  A whole
buffer of documents is hashed at once: byte values from a fixed 64-bit table are weighted by
the powers of an odd base, and a prefix sum modulo 2**64 gives each word's polynomial by one
subtraction.  Nothing loops over words in Python.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SEGMENT = 1 << 20  # bytes hashed at once; a longer word makes a longer segment

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * SEGMENT)
        for i, b in enumerate((_BASE, _BASE_INV)):
            x = np.full(n, U64(b), dtype=U64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=U64)
    return _powers[0], _powers[1]


def _segment_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one buffer."""
    up, down = _power_tables(len(buf) + 1)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buf) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(buf) and inside[-1]:
        edge = np.concatenate((edge, [len(buf)]))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(buf) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and len(texts) + 1 offsets into them."""
    return word_places(texts)[:2]


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, each word's start in the lower-cased texts joined by newlines, and that buffer."""
    whole = b"\n".join(texts).lower()
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    buf = np.frombuffer(whole, dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + SEGMENT)
        while end < len(buf) and not _SPACE[buf[end]]:  # cut at white space only
            step = np.flatnonzero(_SPACE[buf[end : end + SEGMENT]])
            end = end + int(step[0]) if len(step) else min(len(buf), end + SEGMENT)
        h, s = _segment_words(buf[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, bounds), s, buf


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and offsets per document.

    A document with fewer than k words (but at least one) has its whole sequence as one.
    """
    n = np.diff(offsets)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = h * _STEP + words[j : len(words) - k + 1 + j]
        h = mix(h)
    else:
        h = np.zeros(0, U64)
    parts, counts = [], np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        keep = np.zeros(len(h) + k, dtype=np.int64)
        for a, c in ((offsets[:-1][counts > 0], 1), ((offsets[:-1] + counts)[counts > 0], -1)):
            np.add.at(keep, a, c)
        return h[np.cumsum(keep)[: len(h)] > 0], np.concatenate(([0], np.cumsum(counts)))
    counts[short] = 1
    for i in range(len(n)):
        a, m = int(offsets[i]), int(n[i])
        if m >= k:
            parts.append(h[a : a + m - k + 1])
        elif m:
            x = U64(m)
            for w in words[a : a + m]:
                x = (np.array([x]) * _STEP + w)[0]
            parts.append(mix(np.array([x ^ U64(0xA5A5A5A5A5A5A5A5)])))
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(counts)))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
