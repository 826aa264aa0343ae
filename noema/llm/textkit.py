"""Whole-text kernels over Arrow string buffers: word boundaries and 64-bit hashes without a Python loop
over words. All functions take and return numpy arrays, so a task handles a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one kernel call takes, unless a single document is longer.
CHUNK_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Visible ASCII characters other than letters and digits.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=U64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=U64))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Spans:
    """Polynomial hashes of any spans of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-white bytes; rows never share a word."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return Spans(_BYTE[data], base).of(starts, ends) if len(starts) else np.zeros(0, dtype=U64)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of n rows begin, with the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges of the column: (first row, last row, sorted distinct shingle hashes by row, bounds).

    Letters A-Z are lowered. A row with fewer words than width has its whole sequence as one shingle; a row
    without words has none.
    """
    offsets, data = utf8(texts)
    for first, last in chunks(offsets):
        offs = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, rows = words(offs, part)
        n = last - first
        bounds = row_bounds(rows, n)
        hashes = word_hashes(part, starts, ends)
        spans = Spans(hashes, BASES[1])
        counts = np.diff(bounds)
        made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        owner = np.repeat(np.arange(n), made)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + bounds[:-1][owner]
        values = spans.of(at, at + np.minimum(width, counts)[owner])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[keep], owner[keep]
        yield first, last, values, row_bounds(owner, n)
