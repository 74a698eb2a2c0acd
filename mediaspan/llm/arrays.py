"""Word hashes of Arrow text columns with numpy, a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Words of more bytes are hashed by BLAKE2.
LONG_WORD = 256
_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (two multiply and shift rounds)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA3B195354A39B70D)
    return x ^ (x >> _U(32))


def separators(chars: bytes) -> np.ndarray:
    """A table of 256 flags that marks ``chars``."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: The space and the control characters 9 to 13.
BLANKS = separators(b" \t\n\v\f\r")
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest slice needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _BASE, _U)]), dtype=_U)
            self.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, inverse, _U)]), dtype=_U)
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """Words of a slice of texts: ``hashes``, byte ``starts`` and ``ends`` in ``data``, and ``first``, where each text's words begin (one more entry than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray, lower: bool) -> None:
        self.data, self.offsets = data, offsets
        inner = ~blanks[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins, stops = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1] | cut[1:-1]
        stops[:-1] &= ~inner[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = _POWERS.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U))
        # a polynomial modulo 2**64 has equal values for some long words of two letters
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            word = data[self.starts[k] : self.ends[k]].tobytes()
            self.hashes[k] = int.from_bytes(blake2b(word.translate(_TO_LOWER) if lower else word, digest_size=8).digest(), "little")

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def slices(column: pa.Array, blanks: np.ndarray = BLANKS, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its words) for runs of whole texts of about SLICE_BYTES; a longer text is a run of its own. Null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], blanks, lower)
        at = to


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each ``n`` consecutive entries; empty where there are fewer."""
    if len(hashes) < n or not n:
        return np.zeros(0, _U)
    up, down = _POWERS.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1] + _U(n))


def spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span ``begin[i]:end[i]`` of entries."""
    up, down = _POWERS.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U))


def sliding(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``n`` consecutive values."""
    span = 1
    while span < n:
        step = min(span, n - span)
        values = best(values[:-step], values[step:])
        span += step
    return values


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each run of ``n`` words in a slice of ``total`` words, whether it lies in one text."""
    good = np.ones(max(0, total - n + 1), bool)
    for k in first[1:-1]:
        good[max(0, k - n + 1) : k] = False
    return good
