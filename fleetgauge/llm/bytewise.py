"""Whole columns of text as one byte array: words, hashes and pieces without a loop per row.

Everything here works on the bytes of an Arrow string column. A piece is a run of rows of at
most a few megabytes (one longer row is a piece of its own), so that the temporary arrays
of a task stay small however large the Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

_SEED = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)


class _Kept(dict):
    """A cache that is empty again wherever it is sent."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most `limit` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n + 1 offsets of the rows into the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1], offsets[1:]
    full = ends > begins
    first[begins[full]] |= inside[begins[full]]
    last[ends[full] - 1] |= inside[ends[full] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept, and made longer when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one more than there are bytes; see `range_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(BYTE_VALUES[data] * _power(BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    return mix((sums[stops] - sums[starts]) * _power(_INVERSE, len(sums))[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and n + 1 offsets of the rows into the words."""
    if lower:
        data = LOWER[data]
    starts, stops, rows = word_spans(data, offsets, word)
    return range_hash(prefix_hash(data), starts, stops), rows


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside a row, and where each starts. A row with fewer words
    but not none gives its whole sequence as one run."""
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    scaled = words * _power(BASE, total)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(scaled, out=sums[1:])
    counts = np.diff(rows)
    row_of = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(total)
    end = np.minimum(start + n, rows[1:][row_of])
    use = (end - start == n) | ((start == rows[:-1][row_of]) & (counts[row_of] < n))
    start, end = start[use], end[use]
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * _power(_INVERSE, total)[start] + length * np.uint64(0x2545F4914F6CDD1D)), start


#: Compared numbers keep their position in this many low bits; longer inputs must be cut up.
POSITION_BITS = 22


def ranked(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their positions in the low bits: the smallest is the leftmost smallest."""
    return (hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(hashes), dtype=np.uint64)


def position(rank: np.ndarray) -> np.ndarray:
    return (rank & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def sliding_min(ranks: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours: running minima inside blocks, forwards and back."""
    n = len(ranks)
    if n < width:
        return np.zeros(0, np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = ranks
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).reshape(-1)
    back = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])
