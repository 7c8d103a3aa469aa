"""Word and shingle hashes of whole Arrow string columns, without a Python object per word.

A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums over a slice of the
column's buffer, then mixed. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Slices of about so many bytes are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES + 1), base, U64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
        if n > 4 * SLICE_BYTES:
            del _powers[base]  # don't keep tables that one huge text needed
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(name)
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


#: White space and punctuation: all of ASCII but 0-9, A-Z and a-z.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(col: pa.Array, lower: bool = False, slice_bytes: int = SLICE_BYTES, gaps: np.ndarray = _SPACE):
    """Slices of the rows: (first row, word offsets of its rows, word hashes). gaps: the bytes that words don't have."""
    if not len(col):
        return
    data, offsets = buffers(col)
    table = _LOWER if lower else _SAME
    row, n = 0, len(col)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        at = offsets[row : end + 1] - offsets[row]
        raw = data[offsets[row] : offsets[end]]
        yield row, *_hash(raw, at, table, gaps)
        row = end


def _hash(raw: np.ndarray, at: np.ndarray, table: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(len(at), np.int64), np.zeros(0, U64)
    space = gaps[raw]
    edge = np.zeros(n + 1, bool)  # no word goes across these places
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    full = ~space
    starts = np.flatnonzero(full & before)
    ends = np.flatnonzero(full & after) + 1
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((table[raw].astype(U64) + U64(1)) * _power(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts]
    h = mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))
    return np.searchsorted(starts, at), h


def shingles(offsets: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of k words, never across rows: (shingle offsets of the rows, hashes, place of the first word in h).

    A row of fewer words has one shingle of all of them; a row without words has none.
    """
    lens = np.diff(offsets)
    count = np.where(lens >= k, lens - k + 1, np.minimum(lens, 1))
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=out[1:])
    if not out[-1]:
        return out, np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    left = np.repeat(offsets[1:], count) - first  # words from here to the row's end
    acc = np.zeros(out[-1], U64)
    last = len(h) - 1
    for j in range(k):
        word = h[np.minimum(first + j, last)]
        acc = acc * U64(0x2545F4914F6CDD1D) + np.where(left > j, word, U64(0))
    return out, mix(acc), first


def spans(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from each first to before each end, which are equal where these words are."""
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _power(_BASE, len(h)), out=sums[1:])
    return mix((sums[end] - sums[first]) * _power(_INVERSE, len(h))[first] + (end - first).astype(U64))


def runs(offsets: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `shingles`, of rows of at least k words alone, and by other hashes: differences of sums, whose cost doesn't rise with k."""
    lens = np.diff(offsets)
    count = np.maximum(lens - k + 1, 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=out[1:])
    if not out[-1]:
        return out, np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _power(_BASE, len(h)), out=sums[1:])
    return out, mix((sums[first + k] - sums[first]) * _power(_INVERSE, len(h))[first] + U64(k)), first
