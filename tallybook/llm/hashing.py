"""Hashes of words and of word windows, for whole Arrow columns of texts at a time."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; longer texts go in pieces that end at a blank.
CHUNK = 1 << 20
#: Rows of a batch that are copied at once.
ROWS = 1024

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A number for each byte; the second table gives A-Z the numbers of a-z.
_PLAIN = mix(np.arange(1, 257, dtype=_U) * _BASE)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_STEPS = mix(np.arange(1000, 1256, dtype=_U) * _BASE) | _U(1)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = _U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hash_chunk(data: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that ``bounds`` cuts ``data`` into, and the words of each text."""
    size = len(data)
    if not size:
        return np.empty(0, _U), np.zeros(len(bounds) - 1, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~blank
    first, last = word.copy(), word.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    filled = bounds[1:] > bounds[:-1]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    room = 1 << max(20, int(size - 1).bit_length())
    up, down = _powers(room)
    sums = np.zeros(size + 1, _U)
    np.cumsum(numbers[data] * up[:size], out=sums[1:])
    hashes = mix((sums[ends + 1] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def lean(run: Callable) -> Callable:
    """A function over batches that gives freed memory back to the system after each task.

    Workers serve task after task; what allocators keep for later would add up beside the executor's heap.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def hashed_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, word counts, word hashes)`` for runs of rows; all words of a row are in one run.

    Words are runs of bytes other than ASCII blanks. Null texts have none. ``lower`` folds A-Z.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for begin in range(0, len(texts), ROWS):
        for row, counts, hashes in _hashed_slice(texts.slice(begin, ROWS), _LOWER if lower else _PLAIN):
            yield begin + row, counts, hashes


def _hashed_slice(texts: pa.Array, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        begin = offsets[row]
        stop = max(row + 1, int(np.searchsorted(offsets, begin + CHUNK, side="right")) - 1)
        stop = min(stop, len(texts))
        if stop == row + 1 and offsets[stop] - begin > CHUNK:
            parts = []
            for low, high in _pieces(data, int(begin), int(offsets[stop])):
                parts.append(_hash_chunk(data[low:high], np.array([0, high - low]), numbers)[0])
            hashes = np.concatenate(parts)
            yield row, np.array([len(hashes)]), hashes
        else:
            bounds = offsets[row : stop + 1] - begin
            hashes, counts = _hash_chunk(data[begin : offsets[stop]], bounds, numbers)
            yield row, counts, hashes
        row = stop


def _pieces(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    while begin < end:
        stop = min(end, begin + CHUNK)
        while stop < end:
            ahead = data[stop : stop + 4096]
            blanks = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            if len(blanks):
                stop += int(blanks[0])
                break
            stop = min(end, stop + 4096)
        yield begin, stop
        begin = stop


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a text, and their number by text."""
    numbers = np.maximum(counts - size + 1, 0)
    if len(hashes) < size:
        return np.empty(0, _U), numbers
    span = len(hashes) - size + 1
    sums = np.zeros(span, _U)
    for k in range(size):
        sums += hashes[k : k + span] * _STEPS[k]
    ends = np.cumsum(counts)
    inside = np.arange(span) + size <= np.repeat(ends, counts)[:span]
    return mix(sums[inside]), numbers


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the distinct hashes of its ``size``-word windows, sorted.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    found, numbers = windows(hashes, counts, size)
    begins, at = np.cumsum(numbers) - numbers, np.cumsum(counts) - counts
    out = []
    for n, begin, c, word in zip(numbers.tolist(), begins.tolist(), counts.tolist(), at.tolist(), strict=True):
        if n:
            out.append(np.unique(found[begin : begin + n]))
        elif c:
            out.append(mix((hashes[word : word + c] * _STEPS[:c]).sum(dtype=_U, keepdims=True)))
        else:
            out.append(np.empty(0, _U))
    return out
