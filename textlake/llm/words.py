"""Vectorised word splitting and hashing over UTF-8 bytes.

A word is a maximal run of bytes other than space and \\t..\\r, which in UTF-8 is a maximal run of
characters outside [\\x20\\x09-\\x0D]. Hashes are polynomial prefix sums modulo 2**64 with an odd base,
so that every word of a chunk is hashed by a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK * 2, 1 << int(n).bit_length())
    if size not in _powers:
        if size > CHUNK * 2:
            _powers.clear()  # one large table at a time
        step = np.full(size, BASE, np.uint64)
        back = np.full(size, BASE_INVERSE, np.uint64)
        step[0] = back[0] = 1
        _powers[size] = np.cumprod(step), np.cumprod(back)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about CHUNK bytes at most."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > CHUNK:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def hashed(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one chunk: (buffer, word starts, word ends, word hashes, first word of each text plus the total)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = lower_ascii(buf)
    word = (buf != 32) & ((buf < 9) | (buf > 13))
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    step, back = _tables(len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * step[: len(buf)], out=total[1:])
    value = (total[ends] - total[starts]) * back[starts]
    value = mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    first = np.searchsorted(starts, at)
    return buf, starts, ends, value, first


def grams(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; a gram may cross a text's end, which callers cut off."""
    m = len(value) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ value[k : k + m]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        out ^= out >> np.uint64(29)
    return mix(out)
