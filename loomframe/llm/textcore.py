"""Words, windows and lines of Arrow string columns as NumPy arrays.

Texts stay in the Arrow buffer: bytes are classified by table look-up, and a
word's 64-bit value comes from one running polynomial sum over the bytes, so no
Python object is made per word. Values are mixed to 64 bits; two different
words, windows or lines of one comparison agree by chance with 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 17

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer characters separates here.
PUNCT = np.ones(256, dtype=bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = {fold: _letters(fold) for fold in (False, True)}
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        size = max(n, CHUNK + 1)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:n]


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about CHUNK bytes."""
    data, offsets = column(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Spans:
    """Maximal runs of bytes that do not separate, text by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separates: np.ndarray, fold: bool = False):
        self.offsets, n = offsets, len(data)
        inside = ~separates[data]
        first, last = np.empty(n, bool), np.empty(n, bool)
        if n:
            first[0], last[-1] = True, True
            first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
            starts = offsets[:-1]
            first[starts[starts < n]] = True
            ends = offsets[1:]
            last[ends[ends > 0] - 1] = True
        self.start = np.flatnonzero(inside & first)
        self.end = np.flatnonzero(inside & last) + 1
        #: at[d]:at[d + 1] are the spans of text d
        self.at = np.searchsorted(self.start, offsets)
        self.value = mix(polynomial(data, self.start, self.end, fold))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def polynomial(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit value of each data[start:end], equal for equal bytes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[fold][data] * _power(_BASE, n), dtype=np.uint64, out=total[1:])
    return (total[end] - total[start]) * _power(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64)


def windows(values: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all k-word windows and their bounds by text: windows[bounds[d]:bounds[d + 1]] are those of text d."""
    counts = np.maximum(np.diff(at) - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], counts)
    total = np.zeros(len(first), np.uint64)
    for j in range(k):
        total += mix(values[first + j] + _WINDOW[j % 8] * np.uint64(j // 8 + 1)) * _WINDOW[(j + 3) % 8]
    return mix(total + np.uint64(k)), bounds


def whole(values: np.ndarray) -> np.uint64:
    """One value of a short sequence, unlike that of any window of it."""
    total = np.uint64(len(values)) * _WINDOW[7]
    with np.errstate(over="ignore"):
        for j, x in enumerate(values):
            total = mix(np.array([total ^ (x + _WINDOW[j % 8])], np.uint64))[0]
    return total


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
