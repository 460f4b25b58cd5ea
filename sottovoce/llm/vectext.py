"""Vectorised reading of text columns inside tasks: bytes, words and their 64-bit hashes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spaced(*spans: tuple[int, int]) -> np.ndarray:
    """A table of bytes that belong to words: all but those in the spans (both ends included)."""
    out = np.ones(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = False
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, joined, and where each row starts (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20):
    """Runs of whole rows with about `size` bytes each: (first row, its bytes, its starts)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z."""
    return _FOLD[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def runs(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes in `inside`, within one row, begin and where they end (their last byte)."""
    n = len(data)
    is_in = inside[data]
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    begin = is_in.copy()
    begin[1:] &= ~is_in[:-1] | first[1:n]
    stop = is_in.copy()
    stop[:-1] &= ~is_in[1:] | first[1:n]
    return np.flatnonzero(begin), np.flatnonzero(stop)


def run_hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of runs that begin at `at` and whose last bytes are at `to`."""
    n = len(data)
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[to + 1] - total[at]) * down[at] + (to - at).astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words (runs of bytes in `inside`, within one row): their 64-bit hashes in order, and how many words stand before each row starts (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    at, to = runs(data, starts, inside)
    return run_hashes(data, at, to), np.searchsorted(at, starts)


_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def letters(data: np.ndarray) -> np.ndarray:
    """ASCII other than letters to spaces, A-Z to a-z; other bytes as they are."""
    return _LETTERS[data]


def grams(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each byte, it and the n - 1 bytes before it within its row (before a row there are spaces), packed into an integer; n is at most 7."""
    rows = len(starts) - 1
    padded = np.full(len(data) + rows * (n - 1), 0x20, np.uint8)
    places = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(starts)) * (n - 1)
    padded[places] = data
    out = np.zeros(len(data), np.uint64)
    wide = padded.astype(np.uint64)
    packed = np.zeros(max(len(padded) - n + 1, 0), np.uint64)
    for k in range(n):
        packed = packed << np.uint64(8) | wide[k : k + len(packed)]
    out[:] = packed[places - (n - 1)]
    return out


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; 0 for an empty row."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Adds up (keys, counts) tables by key; counts may have columns."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts])
    out = np.zeros((len(keys), *counts.shape[1:]), counts.dtype)
    np.add.at(out, back, counts)
    return keys, out


class Places:
    """Finds where keys stand in a given list of distinct keys: an array of slots, with a further one for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray) -> None:
        self.layers: list[tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]] = []
        left, at, seed = keys.astype(np.uint64), np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            bits = max(8, int(len(left) * 3).bit_length())
            salt, shift = np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)), np.uint64(64 - bits)
            slot = (mix(left ^ salt) >> shift).astype(np.int64)
            slots, held = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
            slots[slot] = at
            held[slot] = left
            self.layers.append((slots, held, salt, shift))
            kept = slots[slot] == at
            left, at, seed = left[~kept], at[~kept], seed + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not listed."""
        out = np.full(len(keys), -1, np.int32)
        open_ = None
        for slots, held, salt, shift in self.layers:
            asked = keys if open_ is None else keys[open_]
            slot = (mix(asked ^ salt) >> shift).astype(np.int64)
            place = slots[slot]
            same = (held[slot] == asked) & (place >= 0)
            if open_ is None:
                out[same] = place[same]
                open_ = np.flatnonzero(~same & (place >= 0))
            else:
                out[open_[same]] = place[same]
                open_ = open_[~same & (place >= 0)]
            if not len(open_):
                break
        return out
