"""Word kernels over whole Arrow string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is the pattern
``[^\\x20\\x09-\\x0D]+`` on the UTF-8 form of a text (those bytes never occur inside a
multi-byte character).  Everything here works on one buffer for many documents, so the
cost is a few vector passes over the bytes and not a Python step per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 20


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    return _splitmix(x + np.uint64(0x9E3779B97F4A7C15))


_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n; grown when a longer segment comes."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, _SEGMENT + 4096)
        for key, base in (("p", _P), ("inv", pow(_P, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"][:n], _powers["inv"][:n]


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offs - first


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each document's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = _WORD_BYTE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word, equal for equal bytes wherever the word stands.

    The bytes are taken in segments that end between words, so memory stays bounded for
    a text of any length.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        piece = data[base : int(ends[j - 1])]
        if lower:
            piece = _LOWER[piece]
        p, inv = _power_tables(len(piece) + 1)
        sums = np.empty(len(piece) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUE[piece] * p[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; windows over a document's edge are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(_Q) + words[j : j + n]
    return mix(total)


def whole_hash(words: np.ndarray) -> np.uint64:
    """The hash of a sequence shorter than a window, apart from all windows' hashes."""
    total = len(words)
    for w in words.tolist():
        total = (total * _P + w) & _MASK
    return mix(np.array([total ^ _Q], dtype=np.uint64))[0]
