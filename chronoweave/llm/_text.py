"""Vectorised word and shingle hashing over UTF-8 text.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; those bytes never occur
inside a multi-byte UTF-8 character, so bytes and code points cut the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WS = b" \t\n\x0b\x0c\r"
_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS)] = True
#: Bytes hashed at a time; the arrays take about 50 bytes for each.
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_POW = np.array([1], np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _P, np.uint64))])
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a block of bytes."""
    n = len(buf)
    ws = _IS_WS[buf]
    edge = np.diff(np.concatenate([[True], ws, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    at = np.arange(n)
    offset = at - np.maximum.accumulate(np.where(ws, at, -1)) - 1
    np.maximum(offset, 0, out=offset)
    value = (buf.astype(np.uint64) + np.uint64(1)) * _powers(int(offset.max()) + 1)[offset]
    value[ws] = 0
    return starts, ends, mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def word_blocks(texts: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, word hashes of each text), text by text in order.

    Texts are hashed several at a time; one text above BLOCK is hashed in pieces cut at
    white space, so memory follows the longest word and not the longest text.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            yield i, [_long(texts[i])]
        else:
            buf = np.frombuffer(b"\n".join(texts[i:j]), np.uint8)
            starts, _, h = words(buf)
            bounds = np.cumsum([len(t) + 1 for t in texts[i : j - 1]])
            yield i, np.split(h, np.searchsorted(starts, bounds))
        i = j


def _long(text: bytes) -> np.ndarray:
    buf, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(buf):
        end = min(at + BLOCK, len(buf))
        while end < len(buf) and not _IS_WS[buf[end]]:
            end += 1
        out.append(words(buf[at:end])[2])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_COEF = np.cumprod(np.full(16, 0xD6E8FEB86659FD93, np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` words, in order."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _COEF[0]
    for k in range(1, n):
        out += h[k : k + m] * _COEF[k]
    return mix(out)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; the whole sequence where there are fewer words."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return grams(h, len(h)) ^ mix(np.array([len(h)], np.uint64))
    return np.unique(grams(h, n))


def lower_bytes(values) -> list[bytes]:
    """UTF-8 with A-Z lower-cased (bytes.lower touches ASCII only); null reads as empty."""
    return [v.encode().lower() if isinstance(v, str) else b"" for v in values]
