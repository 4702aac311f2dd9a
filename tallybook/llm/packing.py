"""Packing tokenised documents into as few sequences as can be.

The instance is the number of pieces of each length, at most ``capacity`` numbers whatever the documents. Dominance
(Martello and Toth) fixes sets of pieces that no better packing needs to part, many copies at a time; best fit packs the
remainder, again many equal sequences at a time. The resulting plan says for each length which numbers of its
pieces go where, and every piece looks itself up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_runs import NOT_BLANK, byte_runs, odd_words, plain_parts
from .common import numbered, written
from .hashing import lean

CAPACITY = 4096
END = 1
#: Different parts of words whose ids a worker keeps; beyond it, it starts anew.
KNOWN_PARTS = 800_000
#: Bytes of text whose words are looked up together.
CHUNK = 1 << 23
#: Parts that are tokenised in one call.
CALL = 20_000

PIECES = "doc_id long, piece int, start long, length int, ids binary"


class PartIds:
    """Ids of parts of words, each tokenised once.

    The tokenizer neither lets a token span white space nor, in plain words, a change between letters, digits and
    other characters, and ends each such part with a token of its own kind. So the parts of many words are tokenised in
    one call and told apart by these tokens. Words that are not plain are told apart by the places of their tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        last = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[last] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _by_place(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, told apart by where in the joined text a token starts."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        places = np.fromiter((first for first, _ in found.offsets), np.int64, len(found.ids))
        sizes = np.bincount(np.searchsorted(begins, places, side="right") - 1, minlength=len(words))
        return np.array(found.ids, np.uint32), sizes

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode("ascii"), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(words):
            return self._by_place(words)
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, words: pa.Array) -> None:
        odd = odd_words(words) if len(words) else np.empty(0, bool)
        flats, starts = [self.flat], [self.starts]
        for which, encode in ((odd, self._by_place), (~odd, self._together)):
            own = words.filter(pa.array(which)).to_pylist()
            for k in range(0, len(own), CALL):
                ids, sizes = encode(own[k : k + CALL])
                flats.append(ids)
                starts.append(starts[-1][-1] + np.cumsum(sizes))
            self.known.update(zip(own, range(len(self.known), len(self.known) + len(own)), strict=True))
        self.flat, self.starts = np.concatenate(flats), np.concatenate(starts)

    def encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after the other, and how many each has."""
        coded = parts.dictionary_encode()
        different = coded.dictionary
        if len(self.known) + len(different) > KNOWN_PARTS:
            self._clear()
        listed = different.to_pylist()
        spots = np.array([self.known.get(part, -1) for part in listed], np.int64)
        if (spots < 0).any():
            self._learn(different.filter(pa.array(spots < 0)))
            spots = np.array([self.known[part] for part in listed], np.int64)
        spot = spots[coded.indices.to_numpy()]
        first = self.starts[spot]
        sizes = self.starts[spot + 1] - first
        begins = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(first - begins, sizes) + np.arange(int(sizes.sum()))], sizes


@lru_cache(maxsize=2)
def _part_ids(path: str) -> PartIds:
    return PartIds(path)


def _tokenised(path: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            known = _part_ids(public_tokenizers.path("word_bpe_49k.json"))
        else:
            known = _part_ids(path)
        stop = np.array([end], np.uint32)
        for batch in batches:
            keys, waiting, at = batch["doc_id"], [], None
            for row, piece, counts, words in byte_runs(batch["text"], NOT_BLANK, chunk=CHUNK):
                if at is not None and row != at:
                    yield _pieces(keys.slice(at, 1), [np.concatenate([*waiting, stop])], capacity)
                    waiting, at = [], None
                counts, words = plain_parts(counts, words)
                ids, sizes = known.encoded(words)
                if piece >= 0:
                    waiting.append(ids)
                    at = row
                    continue
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
                own = [np.concatenate([part, stop]) for part in np.split(ids, ends[:-1])]
                yield _pieces(keys.slice(row, len(counts)), own, capacity)
            if at is not None:
                yield _pieces(keys.slice(at, 1), [np.concatenate([*waiting, stop])], capacity)

    return run


def _pieces(keys: pa.Array, ids: list[np.ndarray], capacity: int) -> pa.RecordBatch:
    """The rows of some documents, whose ids are cut where they exceed the capacity."""
    lengths = np.array([len(own) for own in ids], np.int64)
    number = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(ids)), number)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = piece * capacity
    size = np.minimum(capacity, lengths[doc] - start)
    flat = np.concatenate(ids).astype("<u4")
    offsets = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    columns = [keys.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), packed]
    return pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids"])


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each row's token ids and ``end``, cut into pieces of at most ``capacity``.

    ``ids`` are little-endian 32-bit numbers, one after the other. ``tokenizer`` is the path of a file for the
    ``tokenizers`` library with word ends, lower case and this cut of words (by default the public vocabulary of
    49,408 entries). A null or blank text is ``end`` alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_tokenised(tokenizer, capacity, end)), PIECES)


class Instance:
    """How many pieces of each length are left, and the sets packed so far as ``(lengths, copies)``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n
        self.packed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def _take(self, lengths: list[int]) -> None:
        """Pack this set as often as it is left."""
        need = Counter(lengths)
        copies = min(int(self.counts[w]) // k for w, k in need.items())
        for w, k in need.items():
            self.counts[w] -= k * copies
        self.packed.append((tuple(sorted(need.items(), reverse=True)), copies))

    def _largest(self, room: int, besides: list[int]) -> int:
        """The longest length left, other than ``besides``, that fits into ``room``; 0 for none."""
        left = self.counts[: max(room, 0) + 1].copy()
        for w in besides:
            if w < len(left):
                left[w] -= 1
        found = np.flatnonzero(left > 0)
        return int(found[-1]) if len(found) else 0

    def dominating(self, longest: int) -> list[int] | None:
        """A set with ``longest`` that can take the place of any other set with it, or none that is known to.

        One set dominates another if the other's pieces can be put in the place of its own, several in one if they
        are together no longer: whatever packing has the other set can swap them without a further sequence.
        """
        room = self.capacity - longest
        besides = [longest]
        best = self._largest(room, besides)
        if not best:
            return [longest]
        if best == room:
            # It fills the sequence: all that goes with the longest piece fits in its place.
            return [longest, best]
        left = self.counts.copy()
        left[longest] -= 1
        found = np.flatnonzero(left)
        least = np.repeat(found[:3], np.minimum(left[found[:3]], 3))[:3]
        if len(least) < 2 or least[:2].sum() > room:
            # At most one other fits, so the longest such is the best.
            return [longest, best]
        if len(least) == 3 and least.sum() <= room:
            return None
        pairs = self._pairs(found[found <= room], left, room)
        if not len(pairs):
            return [longest, best]
        if pairs.sum(axis=1).max() <= best:
            # Any two others fit in the place of the longest one.
            return [longest, best]
        second = self._largest(room - best, [*besides, best])
        if second and pairs[:, 1].max() <= second:
            # Of any two others, the shorter fits in the place of the second, the longer in that of the first.
            return [longest, best, second]
        return None

    @staticmethod
    def _pairs(found: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
        """For each length the longest other one, not shorter, that fits beside it: (longer, shorter)."""
        partner = found[np.searchsorted(found, room - found, side="right") - 1]
        # Two of a length need two pieces of it.
        fits = (found + partner <= room) & (partner >= found) & ((partner > found) | (left[found] > 1))
        return np.stack([partner[fits], found[fits]], axis=1)

    def reduce(self) -> None:
        """Fix dominating sets, from the longest piece down, until no piece has one."""
        changed = True
        while changed:
            changed = False
            for longest in np.flatnonzero(self.counts)[::-1].tolist():
                while self.counts[longest]:
                    found = self.dominating(longest)
                    if found is None:
                        break
                    self._take(found)
                    changed = True

    def best_fit(self) -> None:
        """Put the remainder, longest first, where it leaves the least room; equal sequences are filled alike."""
        open_bins: dict[int, list] = {}
        for length in np.flatnonzero(self.counts)[::-1].tolist():
            left = int(self.counts[length])
            while left:
                room = min((r for r in open_bins if r >= length), default=self.capacity)
                lengths, copies = open_bins[room].pop() if room in open_bins else ((), left)
                if room in open_bins and not open_bins[room]:
                    del open_bins[room]
                each = min(room // length, left)
                filled = min(copies, left // each)
                if lengths and filled < copies:
                    open_bins.setdefault(room, []).append((lengths, copies - filled))
                open_bins.setdefault(room - each * length, []).append(((*lengths, (length, each)), filled))
                left -= each * filled
            self.counts[length] = 0
        self.packed += [own for kept in open_bins.values() for own in kept]


@dataclass
class Plan:
    """For pieces of a length from a number on: copies in a sequence, the first sequence, and the first copy's offset."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def locate(self, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with number ``place`` among those of its length."""
        begins = np.searchsorted(self.length, np.arange(int(self.length.max(initial=0)) + 2))
        low, high = begins[length], begins[length + 1]
        while (high - low > 1).any():
            middle = (low + high) // 2
            above = (high - low > 1) & (self.first[middle] > place)
            below = (high - low > 1) & ~above
            high, low = np.where(above, middle, high), np.where(below, middle, low)
        within = place - self.first[low]
        copy = within % self.copies[low]
        return self.sequence[low] + within // self.copies[low], self.offset[low] + copy * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the pieces go, given how many there are of each length."""
    instance = Instance(counts, capacity)
    instance.reduce()
    instance.best_fit()
    rows, used, sequence = [], Counter(), 0
    for lengths, copies in instance.packed:
        offset = 0
        for length, each in lengths:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * copies
            offset += each * length
        sequence += copies
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def _located(plan: Plan):
    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def located(length: pa.Array, place: pa.Array) -> pa.Array:
        found = plan.locate(length.to_numpy(), place.to_numpy())
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    return located


def packed_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and other columns) with ``sequence_id`` and ``offset``, both from 0.

    Sequences are gapless and at most ``capacity`` long. Pieces of equal length are numbered over ranges of rows, so
    a common length is no group of its own. All columns are written and shuffled for it: leave ``ids`` out, or put a
    digest in their place, where only the places are asked for. Columns of these two names are replaced.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = written(pieces.select("length", "doc_id", "piece", F.struct(*kept).alias("__piece")), "pieces")
    placed = numbered(rows, ["length"], ["doc_id", "piece"], "lengths")
    counts = {r["length"]: r["count"] for r in placed.groupBy("length").count().collect()}
    where = _located(plan(counts, capacity))(F.col("length").cast("long"), F.col("place")).alias("__where")
    return placed.select("__piece", where).select("__piece.*", "__where.sequence_id", "__where.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: all rows of ``docs`` in sequences of ``capacity`` tokens.

    Only documents longer than a sequence are cut. Repeated rows, null ids and null texts (empty: ``end`` alone) are packed
    like others; texts of any length are tokenised whole; an empty table gives an empty result. Which of equally
    long pieces goes where is settled when they are written, and survives lost executors.
    """
    return packed_pieces(tokenised_pieces(docs, tokenizer, capacity, end), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, doc_ids, ids``: whole sequences. A group is one sequence, so at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return grouped.select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), ids.alias("ids"))
