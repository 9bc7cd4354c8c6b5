"""Vectorised text kernels used inside tasks.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of a run
of documents lie in one ``uint8`` array with offsets, and each kernel is a
fixed number of numpy passes over it.  No kernel keeps state between batches,
so memory is bounded by ``SLICE_BYTES`` plus the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

#: The ASCII white space that separates words (0x20, 0x09-0x0D).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_power_cache: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown and kept between calls."""
    have = _power_cache.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length()) if n else 1024
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _power_cache[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rows + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes together stay near ``limit``."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Words:
    """Words of a slice: byte range of each, its row, and first word of each row."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes that are no separators; none crosses a row."""
    n = len(buf)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~separator[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    return Words(start, end, np.searchsorted(start, offs))


#: Words of more bytes are hashed one by one.
LONG_WORD = 512
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def word_codes(buf: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit code for each word's bytes, eight bytes of all words at a time."""
    n = len(words.start)
    length = words.end - words.start
    code = length.astype(np.uint64) * BASE
    if n == 0:
        return code
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    live, start, left = np.arange(n), words.start, length
    giant = np.flatnonzero(length > LONG_WORD)
    if len(giant):
        keep = length <= LONG_WORD
        live, start, left = live[keep], start[keep], left[keep]
        for i in giant:
            text = np.zeros(-(-int(length[i]) // 8) * 8, np.uint8)
            text[: length[i]] = buf[words.start[i] : words.end[i]]
            lanes = text.view(np.uint64)
            code[i : i + 1] += (mix(lanes + BASE) * powers(WORD_BASE, len(lanes))).sum(dtype=np.uint64, keepdims=True)
    while len(live):
        h = (code[live] ^ (eight[start] & _LOW_BYTES[np.minimum(left, 8)])) * WORD_BASE
        code[live] = h ^ (h >> np.uint64(29))
        more = left > 8
        live, start, left = live[more], start[more] + 8, left[more] - 8
    return mix(code)


#: Bytes that end a word of letters and digits: all ASCII but those.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def lower_case(buf: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 (0xC3 0x80-0x9E) lower-cased."""
    out = LOWER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    if len(lead):
        tail = out[lead + 1]
        capital = (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        out[lead[capital] + 1] += 0x20
    return out


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Code of every k consecutive items (row borders are the caller's)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= WORD_BASE
        out += codes[j : j + n]
    return mix(out)


def byte_grams(buf: np.ndarray, log_k: int) -> np.ndarray:
    """Code of every 2**log_k consecutive bytes, by doubling."""
    h, width, factor = BYTE_CODE[buf], 1, int(WORD_BASE)
    for _ in range(log_k):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, width * 2
    return mix(h)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    m, width = values, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[:n], m[w - width : w - width + n])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... of each range, one after the other."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)
