"""Vectorised text primitives shared by the Python-side operators.

Everything here works on one Arrow batch at a time: the concatenated UTF-8 bytes of the batch are
tokenised with numpy, so cost is a few array passes per byte and memory is a small multiple of the
batch.  A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; ``A-Z`` are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: All bytes but ASCII letters, digits and those of other characters: punctuation parts words too.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_POWER = np.uint64(0x9E3779B97F4A7C15)
_MUL_1 = np.uint64(0xBF58476D1CE4E5B9)
_MUL_2 = np.uint64(0x94D049BB133111EB)

#: Hash of the token that ends a text; no word hashes to it except by a 64-bit collision.
END = np.uint64(0xE7037ED1A0B428DB)
#: Hash of the history before a text's first token.
BEGIN = np.uint64(0x8EBC6AF09C88C6E3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MUL_1
    x ^= x >> np.uint64(27)
    x *= _MUL_2
    x ^= x >> np.uint64(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and that of its last item; order matters."""
    return mix(left * _POWER + right)


_weights = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _weights
    if len(_weights) < n:
        size = 1 << int(n - 1).bit_length()
        steps = np.full(size, _POWER, dtype=np.uint64)
        steps[0] = 1
        _weights = np.multiply.accumulate(steps)
    return _weights[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, count per row) of the words, in order."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(first, offsets))


def word_hashes(column: pa.Array, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a column and how many words each row has.

    Words are runs of bytes for which ``space`` is false.

    The words' bytes are laid out back to back and each is reduced to a polynomial in an odd
    multiplier modulo 2**64, then finalised; the same word has the same hash on every machine.
    """
    data, offsets = raw(column)
    hashes, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    row, size = 0, len(offsets) - 1
    while row < size:  # about 4 MB at a time keeps the work inside the cache
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (4 << 20), side="right")) - 1)
        part = data[offsets[row] : offsets[upto]]
        first, last, counts[row:upto] = words(part, offsets[row : upto + 1] - offsets[row], space)
        if len(first):
            body = _LOWER[part[~space[part]]].astype(np.uint64) + np.uint64(1)
            length = last - first
            starts = np.cumsum(length) - length
            place = np.arange(len(body), dtype=np.int64) - np.repeat(starts, length)
            body *= _powers(int(length.max()))[place]
            hashes.append(mix(np.add.reduceat(body, starts) + length.astype(np.uint64) * _MUL_1))
        row = upto
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def batches(stream: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in stream:
        _, offsets = raw(batch.column(column))
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield batch.slice(row, upto - row)
            row = upto
