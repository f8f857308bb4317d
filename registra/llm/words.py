"""Words of whole Arrow text columns as NumPy arrays: places, 64-bit identities and hashes of word windows.

Everything here is vectorised over the bytes of a batch and takes a constant number of bytes of scratch
memory per block of text, so one very long text or one very long word costs time but no extra memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes that separate words: the contracts' [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
WHITE_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes hashed at a time.
BLOCK = 1 << 20
#: Bytes of text worked on together; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_WORD = 1 << 64


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(count - 1, base, dtype=np.uint64)]), dtype=np.uint64)


@dataclass
class _Tables:
    of_byte: np.ndarray
    up: np.ndarray
    down: np.ndarray
    inverse: int


_tables: list[_Tables] = []


def _hash_tables() -> _Tables:
    if not _tables:
        inverse = pow(_BASE, -1, _WORD)
        of_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
        _tables.append(_Tables(of_byte, _powers(_BASE, BLOCK), _powers(inverse, BLOCK), inverse))
    return _tables[0]


@dataclass
class Words:
    """Words of the texts of a slice. `first[i]:first[i + 1]` are the words of text i, `start`/`end` byte places in `data`."""

    data: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit identity of each word: a polynomial over its bytes, modulo 2**64, spread over all bits."""
        tables = _hash_tables()
        sums_at_start = np.zeros(len(self), dtype=np.uint64)
        sums_at_end = np.zeros(len(self), dtype=np.uint64)
        down = np.zeros(len(self), dtype=np.uint64)
        carried = np.uint64(0)
        with np.errstate(over="ignore"):
            for low in range(0, len(self.data), BLOCK):
                block = self.data[low : low + BLOCK]
                up = np.uint64(pow(_BASE, low, _WORD))
                sums = np.zeros(len(block) + 1, dtype=np.uint64)
                np.cumsum(tables.of_byte[block] * tables.up[: len(block)], out=sums[1:])
                sums = sums * up + carried
                a, b = np.searchsorted(self.start, [low, low + len(block)])
                sums_at_start[a:b] = sums[self.start[a:b] - low]
                down[a:b] = tables.down[self.start[a:b] - low] * np.uint64(pow(tables.inverse, low, _WORD))
                a, b = np.searchsorted(self.end, [low + 1, low + len(block) + 1])
                sums_at_end[a:b] = sums[self.end[a:b] - low]
                carried = sums[-1]
            length = (self.end - self.start).astype(np.uint64)
            return mix((sums_at_end - sums_at_start) * down + length * np.uint64(_STEP))

    def window_hashes(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of `width` words inside one text, and the place of its first word."""
        inside = windows_inside(self.first, width)
        return rolling(hashes, width)[inside], inside

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space between neighbours, and each word's start and end in these bytes."""
        in_word = np.zeros(len(self.data) + 1, dtype=np.int8)
        in_word[self.start] += 1
        in_word[self.end] -= 1
        in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        keep = in_word.copy()
        gaps = self.end[self.end < len(self.data)]
        keep[gaps] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        return np.where(in_word, self.data, 0x20).astype(np.uint8)[keep].tobytes(), place[self.start], place[self.end - 1] + 1


def windows_inside(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words that start a run of `width` words of their own text."""
    starts = np.maximum(np.diff(first) - width + 1, 0)
    offset = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts)
    return np.arange(int(starts.sum())) + offset


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` values from each place on; the last places are not whole windows. Built by doubling."""
    total, done, piece, size = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if total is None:
                    total = piece
                else:
                    n = len(hashes) - done
                    shifted = np.zeros_like(hashes)
                    shifted[: max(n, 0)] = piece[done:]
                    total = total + shifted * np.uint64(pow(_STEP, done, _WORD))
                done += size
            if done == width:
                return mix(total)
            longer = piece.copy()
            longer[: max(len(piece) - size, 0)] += piece[size:] * np.uint64(pow(_STEP, size, _WORD))
            piece, size = longer, size * 2


def sliding_minimum(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of the `width` values from each place on (fewer at the end), and the first place that has it."""
    size, least, place = 1, values.copy(), np.arange(len(values))
    while size < width:
        step = min(size, width - size)
        lower = np.flatnonzero(least[step:] < least[: len(least) - step])
        # Both sides are read before any is written.
        least[lower], place[lower] = least[lower + step], place[lower + step]
        size += step
    return least, place


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    bounds = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bounds.astype(np.int64), bytes_


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of at most `most` bytes (or one row): first row, end row, bounds, bytes."""
    bounds, data = _buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1, row + 1)
        end = min(end, rows)
        yield row, end, bounds[row : end + 1] - bounds[row], data[bounds[row] : bounds[end]]
        row = end


def find_words(bounds: np.ndarray, data: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    """Find the words of the texts `data[bounds[i]:bounds[i + 1]]`; a null text is an empty one."""
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Words(data, bounds, np.searchsorted(start, bounds), start, end)
