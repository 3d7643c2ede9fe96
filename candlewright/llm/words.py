"""NumPy kernels over Arrow text columns: words, their hashes, and packed sorted integer sets.

A batch of texts is one byte buffer; words and hashes are found for the whole buffer at once. All
hashes are fixed functions of the bytes, so any task computes the same value for the same word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
#: Bytes that are no part of a term: ASCII but for letters and digits.
NOT_TERM = np.ones(256, bool)
NOT_TERM[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    NOT_TERM[_lo:_hi] = False

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_WINDOW_BASE = np.uint64(0xD1342543DE82EF95)
_WINDOW_INV = np.uint64(pow(int(_WINDOW_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    width = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    offsets = np.frombuffer(arr.buffers()[1], width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes: a text is never cut, so a long one is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each document's first word (n + 1 numbers)."""
    inside = ~breaks[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    start[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span (spans are not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _BYTE[buf[place + np.repeat(starts, size)]] * powers(_BASE, int(size.max()))[place]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words that stays in one document, and the index of its first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_WINDOW_BASE, n), out=total[1:], dtype=np.uint64)
    at = np.arange(n - k + 1)
    last = np.repeat(first[1:], np.diff(first))[: n - k + 1]
    at = at[at + k <= last]
    return mix((total[at + k] - total[at]) * powers(_WINDOW_INV, n)[at] + np.uint64(k)), at


def documents_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences of one byte width: about log2(range / count) bits each."""
    if not len(values):
        return b"\x01"
    step = values.copy()
    step[1:] -= values[:-1]
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :width] = body
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)
