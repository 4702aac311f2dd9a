"""Words of texts as Arrow arrays, cut from the UTF-8 bytes of whole columns at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once; a longer text goes in pieces that end between words.
CHUNK = 1 << 22
#: Rows of a batch that are copied at once.
ROWS = 8192

_BYTES = np.arange(256)
#: All but ASCII blanks.
NOT_BLANK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: ASCII letters and every byte of other characters.
LETTERS = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128)
AS_IS = _BYTES.astype(np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


#: Plain words are cut further: at changes between letters and other characters, and around every digit.
_ODD = (_BYTES >= 128) | np.isin(_BYTES, [ord(c) for c in "'<|>"])
_KINDS = np.where(LETTERS, 1, np.where((_BYTES >= 48) & (_BYTES <= 57), 2, 0)).astype(np.uint8)


def odd_words(words: pa.Array) -> np.ndarray:
    """Which words hold a character beyond ASCII, an apostrophe or one of ``<|>``."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    odd = np.concatenate([[0], np.cumsum(_ODD[data[: offsets[-1]]])])
    return odd[offsets[1:]] > odd[offsets[:-1]]


def plain_parts(counts: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same text in parts: plain words in runs of letters, runs of other characters and single digits, in lower case.

    Odd words stay whole and as they are.
    """
    if not len(words):
        return counts, words
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    odd = np.repeat(odd_words(words), np.diff(offsets))
    kind = _KINDS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~odd[1:]
    begins[offsets[:-1] - offsets[0]] = True
    starts = np.flatnonzero(begins)
    cuts = np.append(starts, len(data)).astype(np.int32)
    flat = np.where(odd, data, LOWER[data])
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    places = np.append(offsets[:-1] - offsets[0], len(data))[firsts]
    return np.diff(np.searchsorted(starts, places)), parts


def _cut(data: np.ndarray, bounds: np.ndarray, member: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text that ``bounds`` cuts ``data`` into, and all words."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[1:] > bounds[:-1]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts + 1, out=offsets[1:])
    flat = np.ascontiguousarray(fold[data[inside]])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return np.diff(np.searchsorted(starts, bounds)), words


def byte_runs(
    texts: pa.Array, member: np.ndarray, fold: np.ndarray = AS_IS, chunk: int | None = None
) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """``(first row, piece, words of each row, words)`` for runs of rows, in order.

    A word is a longest run of bytes in ``member``, each replaced by ``fold``; null texts have none. A text above
    ``chunk`` (by default ``CHUNK``) bytes comes alone, in pieces 0, 1, ...; other runs hold whole rows and are piece -1.
    """
    chunk = chunk or CHUNK
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for begin in range(0, len(texts), ROWS):
        for row, *rest in _runs_of(texts.slice(begin, ROWS), member, fold, chunk):
            yield begin + row, *rest


def _runs_of(
    texts: pa.Array, member: np.ndarray, fold: np.ndarray, chunk: int
) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        begin = offsets[row]
        stop = max(row + 1, int(np.searchsorted(offsets, begin + chunk, side="right")) - 1)
        stop = min(stop, len(texts))
        if stop == row + 1 and offsets[stop] - begin > chunk:
            low, piece = int(begin), 0
            while low < offsets[stop]:
                high = min(low + chunk, int(offsets[stop]))
                while high < offsets[stop] and member[data[high]]:
                    high += 1
                yield row, piece, *_cut(data[low:high], np.array([0, high - low]), member, fold)
                low, piece = high, piece + 1
        else:
            yield row, -1, *_cut(data[begin : offsets[stop]], offsets[row : stop + 1] - begin, member, fold)
        row = stop
