"""Vectorised word shingles over Arrow text batches: NumPy over the UTF-8 bytes, no string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
#: A random 64-bit value per byte, zero for white space.
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[_SPACE] = 0
_VALUE_LOWER = _VALUE[_LOWER]
_STEP = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def _power(kind: str, radix: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK + 1), radix, np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= CHUNK + 1:
            _powers[kind] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    # a slice shares its parent's bytes: only its own are looked at
    own = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, offs - offs[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most CHUNK bytes (or one document)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def sliced(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most CHUNK bytes of the text column at ``at`` (or one row), so that what is computed
    for a slice, many times its text, stays small."""
    for batch in batches:
        column = batch.column(at)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))])
        for i, j in chunks(offsets):
            yield batch.slice(i, j - i)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (maximal run without white space), and the number of words of each document.

    ``data`` holds just these documents, ``offs`` starts at 0.
    """
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] & ~word[:-1]
    if n:
        edge[0] = word[0]
    inner = offs[:-1][(offs[:-1] < n) & (np.diff(offs) > 0)]
    edge[inner] = word[inner]
    starts = np.flatnonzero(edge[:n])
    stop = np.zeros(n + 1, bool)
    stop[1:n] = word[:-1] & ~word[1:]
    if n:
        stop[n] = word[-1]
    bound = inner[inner > 0]
    stop[bound] |= word[bound - 1]
    ends = np.flatnonzero(stop)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * _power("up", _RADIX, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts] + _STEP[63] * (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offs))


def shingle_sets(column: pa.Array, width: int, lower: bool) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text of fewer than ``width`` words has one shingle, its whole word sequence; a text without words has none.
    """
    data, offs = text_buffers(column)
    for i, j in chunks(offs):
        own = offs[i : j + 1] - offs[i]
        words, counts = word_hashes(data[offs[i] : offs[j]], own, lower)
        ends = np.cumsum(counts)
        if len(words) >= width:
            rolled = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                rolled += words[k : k + len(rolled)] * _STEP[k]
            rolled = mix(rolled)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= width:
                own_hashes = np.sort(rolled[end - n : end - width + 1])
                keep = np.ones(len(own_hashes), bool)
                np.not_equal(own_hashes[1:], own_hashes[:-1], out=keep[1:])
                yield own_hashes[keep]
            elif n:
                yield mix((words[end - n : end] * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + _STEP[32 + min(n, 30)])
            else:
                yield np.zeros(0, np.uint64)
