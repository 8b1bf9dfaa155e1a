"""Words and word shingles of whole Arrow text columns, computed on the UTF-8 bytes with numpy.

A batch is worked on in pieces of about a million bytes, cut between words, so temporary arrays stay small however long a
text is; only a single word longer than a piece makes them grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Odd base of the word polynomial modulo 2**64 and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of a batch after which it is cut, so that long texts don't pile up in one batch.
BATCH_BYTES = 8 << 20


def _mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole 64-bit word."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mixed = _mixed


def keyed(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit words that depend on the seed alone."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, UNBASE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


#: ASCII letters A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word when ASCII white space (20, 09-0D) separates.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of a word that is a run of ASCII letters, digits and non-ASCII code points.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A random 64-bit value for each byte, the same for both cases of a letter, and one that keeps them apart.
_VALUES = keyed(11, 256)[LOWER]
_CASED = keyed(12, 256)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without copying, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each together stay under ``most`` bytes, or are one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word numbers at which the rows begin; no word crosses rows."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cased: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are sorted and don't overlap. Not cased: A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    values = _CASED if cased else _VALUES
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK, "right")))
        low, high = int(starts[k]), int(ends[stop - 1])
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[:-1], out=sums[1:])
        a, b = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        k = stop
    return _mixed(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and the n + 1 word numbers at which the rows begin."""
    starts, ends, rows = word_spans(data, offsets, table)
    return span_hashes(data, starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words with repeats, in text order, and the n + 1 shingle numbers at which rows begin.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    weights = keyed(21, size) | np.uint64(1)
    words = np.diff(rows)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    begins = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(begins[-1], np.uint64)
    if len(hashes) >= size:
        total = np.zeros(len(hashes) - size + 1, np.uint64)
        for k in range(size):
            total += hashes[k : len(hashes) - size + 1 + k] * weights[k]
        total = _mixed(total)
        long = np.flatnonzero(words >= size)
        at = np.repeat(rows[:-1][long] - begins[:-1][long], counts[long]) + _ranges(begins[:-1][long], counts[long])
        out[_ranges(begins[:-1][long], counts[long])] = total[at]
    for k in np.flatnonzero((words > 0) & (words < size)):
        own = hashes[rows[k] : rows[k + 1]]
        out[begins[k]] = _mixed((own * weights[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, begins


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - heads, counts)


ranges = _ranges


def binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """A binary column whose row k holds the raw items ``values[begins[k]:begins[k + 1]]``."""
    data = np.ascontiguousarray(values)
    offsets = (np.asarray(begins, np.int64) * data.itemsize)
    if len(offsets) and offsets[-1] >= 2**31:
        raise ValueError("a batch of packed rows must stay under 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
