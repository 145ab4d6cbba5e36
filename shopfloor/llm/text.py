"""Vectorised work on the UTF-8 bytes of Arrow string columns, for use inside tasks.

A batch is cut into pieces of a few MB, always between texts, so memory follows the piece (or one
very long text) and not the batch. Words, word hashes and n-gram hashes of a piece are numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21
_MULT, _GRAM = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1B54A32D192ED03)
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but digits and letters; bytes of other characters belong to words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64 = _MULT) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if kind == pa.large_binary() else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them)"""
    if not len(column):
        return
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def slices(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A batch in small parts, for work on Python objects: few texts are held as such at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@dataclass
class Words:
    """Words of several texts in order: byte bounds, hash, and first[i] to first[i + 1] of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), first)
    length = end - start
    letters = data[inside]
    if lower:
        letters = LOWER[letters]
    at = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(at, length)
    values = (letters.astype(np.uint64) + U(1)) * powers(int(length.max()))[place]
    return Words(start, end, mix(np.add.reduceat(values, at)), first)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of x[i : i + n] for each i with i + n <= len(x), by doubling."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out, width, part, part_width = None, 0, x, 1
    while n:
        if n & 1:
            if out is None:
                out, width = part, part_width
            else:
                k = len(part) - width
                out, width = out[:k] * U(pow(int(_GRAM), part_width, 1 << 64)) + part[width : width + k], width + part_width
        n >>= 1
        if n:
            k = len(part) - part_width
            part, part_width = part[:k] * U(pow(int(_GRAM), part_width, 1 << 64)) + part[part_width:], part_width * 2
    return out


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which an n-gram lies within one text, and their texts."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][text] + at, text


def windows_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i : i + n] for each i (van Herk: running minima of blocks from both sides)."""
    if len(x) < n:
        return x[:0]
    full = -(-len(x) // n) * n
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, n)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - n + 1
    return np.minimum(right[:m], left[n - 1 : n - 1 + m])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array column from flat values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
