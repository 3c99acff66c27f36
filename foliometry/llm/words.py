"""Lines, words and their 64-bit hashes for many texts at once, as numpy arrays over one UTF-8 buffer.

A word is a run of bytes other than space and \\x09-\\x0D, which is the same as `[^\\x20\\x09-\\x0D]+` over
code points, because UTF-8 never uses these bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 50_000
LONG_BYTES = 256
SEED = 0x5851F42D4C957F2D

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most BLOCK_ROWS rows and `limit` bytes, or of one longer row; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, row + BLOCK_ROWS, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, cut at text borders, and each text's first run (one more entry than texts)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    fresh = np.empty(len(inside), bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < len(inside)]] = True
    last = np.empty(len(inside), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & fresh)
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty \\n-split lines, and each text's first."""
    return spans(data != 10, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _cut_lane(lane: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Without the bytes behind a span of which `left` bytes are left."""
    short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
    return (lane << short) >> short


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: its length, then eight bytes at a time mixed in; spans over LONG_BYTES by xxh3.

    No sum of bytes is taken, so no arrangement of equal parts, such as a Thue-Morse word, meets its complement.
    """
    sizes = ends - starts
    lanes = _lanes(data)
    out = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(SEED))
    active, at = np.flatnonzero((sizes > 0) & (sizes <= LONG_BYTES)), 0
    while len(active):
        left = sizes[active] - at
        lane = _cut_lane(lanes[starts[active] + at], left)
        out[active] = mix((out[active] ^ lane) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xA0761D6478BD642F))
        at += 8
        active = active[left > 8]
    for k in np.flatnonzero(sizes > LONG_BYTES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], SEED)
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each span has the same bytes as the one of `sizes` bytes from `places` on in others."""
    same = ends - starts == sizes
    lanes, other_lanes = _lanes(data), _lanes(others)
    active, at = np.flatnonzero(same & (sizes > 0) & (sizes <= LONG_BYTES)), 0
    while len(active):
        left = sizes[active] - at
        differ = _cut_lane(lanes[starts[active] + at] ^ other_lanes[places[active] + at], left) != 0
        same[active[differ]] = False
        at += 8
        active = active[(left > 8) & ~differ]
    for k in np.flatnonzero(same & (sizes > LONG_BYTES)).tolist():
        same[k] = np.array_equal(data[starts[k] : ends[k]], others[places[k] : places[k] + sizes[k]])
    return same


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive words, by the first word; the last size-1 entries are missing."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += word_hashes[k : k + n] * np.uint64(pow(0xA0761D6478BD642F, 2 * k + 1, 1 << 64))
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each run, from each text's first run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets, empty ranges included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])
