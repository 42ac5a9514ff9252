"""Vectorised scans over the UTF-8 bytes of many texts at once (numpy, no loop over characters).

Words are maximal runs of bytes other than space and 0x09-0x0D. Hashes are 64-bit, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the mixers (fixed values).
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_VALUE = None
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around silently)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * M2
        x = (x ^ (x >> U64(27))) * M3
        return x ^ (x >> U64(31))


def join_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the pair (a, b); the order counts."""
    with np.errstate(over="ignore"):
        z = a * M2 + (b ^ U64(salt)) * M3
        z ^= z >> U64(29)
        z *= M1
        return z ^ (z >> U64(32))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * M1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", BASE_INV)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The binary column of the n values that n + 1 item offsets cut out of a flat array."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together; one longer text makes a range by itself."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


class Words:
    """All words of some texts: text number, start and end byte, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray = SEPARATOR):
        data = LOWER[data] if lower else data
        n = len(data)
        inside = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.data = data
        self.sums = prefix_sums(data)
        self.hash = span_hash(self.sums, self.start, self.end)

    def first(self, texts: int) -> np.ndarray:
        """Number of the first word of each text, and one more."""
        return np.searchsorted(self.text, np.arange(texts + 1))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of every prefix (mod 2**64)."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal spans have equal hashes."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * M1)


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of k words that lies in one text."""
    h, text = words.hash, words.text
    if len(h) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out = h[:n]
    for i in range(1, k):
        out = join_hash(out, h[i : n + i], i)
    same = text[:n] == text[k - 1 :]
    return out[same], text[:n][same]
