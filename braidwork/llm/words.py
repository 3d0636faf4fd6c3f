"""Vectorised word and window hashing over Arrow string columns.

A word is a run of bytes other than space and \\x09-\\x0D. Everything here works on whole texts, a chunk of documents at
a time, so the memory used is bounded by the chunk size or by the longest single document. Null texts have no words.
Hashes are 64-bit and depend only on the words, so they agree between workers, retries and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xD6E8FEB86659FD93
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)
U64 = np.uint64

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Tables(dict):
    """A cache that travels to workers empty."""

    def __reduce__(self):
        return _Tables, ()


_TABLES = _Tables()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        table = np.full(1 << max(10, (int(n) - 1).bit_length()), base, U64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if len(table) <= CHUNK_BYTES:  # longer ones, for single long documents, are not kept
            _TABLES[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


class Words:
    """Words of consecutive documents: hash, first and end byte of each, and where each document's words begin."""

    __slots__ = ("doc_bytes", "end", "first", "hashes", "offsets", "raw", "row")

    def __init__(self, row: int, raw: np.ndarray, doc_bytes: np.ndarray, lower: bool, is_space: np.ndarray = _IS_SPACE):
        self.row, self.raw, self.doc_bytes = row, raw, doc_bytes
        n = len(raw)
        if n == 0:
            self.first = self.end = np.zeros(0, np.int64)
            self.hashes, self.offsets = np.zeros(0, U64), np.zeros(len(doc_bytes), np.int64)
            return
        space = is_space[raw]
        edge = np.ones(n + 1, bool)
        edge[1:n] = space[:-1]
        starts = doc_bytes[:-1]
        edge[starts[starts < n]] = True
        self.first = np.flatnonzero(edge[:n] & ~space)
        last = np.ones(n + 1, bool)
        last[1:n] = space[1:]
        last[doc_bytes[1:]] = True
        self.end = np.flatnonzero(last[1:] & ~space) + 1
        code = (_LOWER[raw] if lower else raw).astype(U64)
        code += U64(1)
        code *= powers(_BASE, n)
        total = np.zeros(n + 1, U64)
        np.cumsum(code, out=total[1:])
        h = (total[self.end] - total[self.first]) * powers(_INVERSE, n)[self.first]
        self.hashes = mix(h ^ ((self.end - self.first).astype(U64) << U64(48)))
        self.offsets = np.searchsorted(self.first, doc_bytes)

    def __len__(self) -> int:
        return len(self.doc_bytes) - 1


#: Everything but ASCII letters and digits and bytes over 127, for words without their punctuation.
NOT_ALPHANUMERIC = np.array([not (chr(c).isalnum() or c > 127) for c in range(256)])


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, is_space: np.ndarray = _IS_SPACE) -> Iterator[Words]:
    """The words of a string column, in chunks of about `limit` bytes (a longer document is a chunk of its own)."""
    offsets, raw = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield Words(row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], lower, is_space)
        row = stop


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries; as many as len(hashes)-k+1, ignoring document borders."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(_WORD_BASE, n), out=total[1:])
    return mix((total[k:] - total[: n + 1 - k]) * powers(_WORD_INVERSE, n)[: n + 1 - k] + U64(k))


def sequence_hash(hashes: np.ndarray) -> int:
    """A hash of the whole sequence."""
    return int(window_hashes(hashes, len(hashes))[0]) if len(hashes) else 0


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles, repeats kept, with offsets by document. Documents of 1 to k-1 words
    have one shingle, the whole sequence; documents without words have none."""
    counts = np.diff(words.offsets)
    full = np.maximum(counts - k + 1, 0)
    number = np.where(counts == 0, 0, np.maximum(full, 1))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=offsets[1:])
    out = np.zeros(offsets[-1], U64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - words.offsets[:-1], number)
    windows = window_hashes(words.hashes, k)
    long = np.repeat(counts >= k, number)
    out[long] = windows[at[long]]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        out[offsets[d]] = sequence_hash(words.hashes[words.offsets[d] : words.offsets[d + 1]])
    return out, offsets


def release() -> None:
    """Give memory that the allocators hold back to the system: idle workers stay around between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: int, limit: int = 4 << 20):
    """Record batches cut so that each holds about `limit` bytes of a text column at most (or one row)."""
    for batch in batches:
        offsets, _ = text_buffers(batch.column(column))
        row, n = 0, batch.num_rows
        while row < n:
            stop = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
            yield batch.slice(row, stop - row)
            row = stop


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
