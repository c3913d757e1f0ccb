"""Words of many texts at once, as positions in their UTF-8 bytes, and their hashes (numpy)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multiplier of the polynomial word hash (arithmetic modulo 2**64) and its inverse.
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(keep) -> np.ndarray:
    """A 256-entry mask of the bytes for which ``keep(byte)`` holds."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Everything but ASCII white space.
NOT_SPACE = table(lambda b: b not in (0x20, *range(0x09, 0x0E)))
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = table(lambda b: b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z; other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """Start, end and row of each word; words do not cross rows."""
    inside = word_bytes[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = begin[1:] - 1
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int):
    """Powers of the base and of its inverse, up to ``n`` (kept between calls)."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data`` (equal bytes, equal hash)."""
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * power[:len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(0xD1B54A32D192ED03))


def runs(values: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (``len(values) - size + 1`` of them)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, seed, _U)
    for j in range(size):
        out = out * _U(0x9FB21C651E98DF25) + values[j:j + n]
        out ^= out >> _U(29)
    return mix(out)
