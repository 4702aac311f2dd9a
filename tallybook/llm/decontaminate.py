"""Benchmark items in documents: SimHash of item-sized windows, found by Hamming blocks, then exact weighted shingles.

A window that is like an item has one of its shingles, so only windows around shingles of items of their size get a
fingerprint: each bit is the weighted majority of the window's shingles. The fingerprints of items are indexed by their
bytes, each with up to two bits flipped: two fingerprints at most ``RADIUS`` bits apart agree so far in one byte at least, so
all of them meet. Pairs that do are verified by their exact weighted shingles.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of, written
from .hashing import hashed_words, lean, mix, shingles, windows

WORDS = 5
PERCENT = 75
BITS = 128
#: Flipped bits of a byte under which an item is indexed.
FLIPS = 2
#: Bits between fingerprints up to which all pairs are found: beyond it every byte may differ in one more bit.
RADIUS = BITS // 8 * (FLIPS + 1) - 1
#: Words of items whose index goes to the executors at once; a larger benchmark is searched in blocks.
MAX_BLOCK_WORDS = 500_000
#: Shingles of a document whose bits are held at once.
STRETCH = 1 << 16

_U = np.uint64
_BITS = np.array([bin(v).count("1") for v in range(256)], np.uint8)
_NEAR = np.array([sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(8), n)], np.uint8)
MATCH = "array<struct<item_id:bigint,start:int,similarity:double>>"


def fingerprints(found: np.ndarray, weights: np.ndarray, span: int, starts: np.ndarray) -> np.ndarray:
    """SimHash (16 bytes each) of the windows of ``span`` shingles at the ascending ``starts``."""
    out = np.empty((len(starts), BITS // 8), np.uint8)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(starts, low + STRETCH)))
        own = slice(low, int(starts[stop - 1]) + span)
        halves = np.stack([mix(found[own]), mix(found[own] ^ _U(0xD6E8FEB86659FD93))], axis=1)
        signs = 2 * np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int32) - 1
        sums = np.zeros((len(signs) + 1, BITS), np.int32)
        np.cumsum(signs * weights[own, None].astype(np.int32), axis=0, out=sums[1:])
        places = starts[at:stop] - low
        out[at:stop] = np.packbits(sums[places + span] > sums[places], axis=1)
        at = stop
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _BITS[a ^ b].sum(axis=1, dtype=np.int32)


def _places(found: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``found`` a place in the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    return at, known[at] == found


class ItemIndex:
    """Items by number: distinct shingles with counts and weights, one after the other, and fingerprints by size."""

    def __init__(
        self, ids: list[int], texts: list[str | None], words: int = WORDS, percent: int = PERCENT,
        among: tuple[int, np.ndarray, np.ndarray] | None = None,
    ):
        """``among`` is what the weights follow from when these items are not all: their number, the sorted
        shingles that more than one of them has, and how many have each.
        """
        self.words, self.percent = words, percent
        self.ids: list[int] = []
        lengths, orders, shares, numbers = [], [], [], []
        for row, counts, hashed in hashed_words(pa.array(texts, pa.string()), lower=True):
            at = 0
            for k, n in enumerate(counts.tolist()):
                if n:
                    self.ids.append(ids[row + k])
                    lengths.append(n)
                    orders.append(self.shingles(hashed[at : at + n]))
                    share, number = np.unique(orders[-1], return_counts=True)
                    shares.append(share)
                    numbers.append(number)
                at += n
        self.lengths = np.array(lengths, np.int64)
        self.bounds = np.cumsum([0, *map(len, shares)])
        self.shares = np.concatenate([*shares, np.empty(0, _U)])
        self.numbers = np.concatenate([*numbers, np.empty(0, np.int64)])
        if among is None:
            seen, times = np.unique(self.shares, return_counts=True)
            among = len(lengths), seen[times > 1], times[times > 1]
        everything, self.repeated, times = among
        #: A shingle weighs 1 and the whole part of log2(items / items with it) more; ``unseen`` with one item or none.
        self.repeated_weights = np.array([1 + int(math.log2(everything / n)) for n in times.tolist()], np.int8)
        self.unseen = 1 + int(math.log2(max(1, everything)))
        self.weights = self.weigh(self.shares)
        whole = np.zeros(1, np.int64)
        prints = [fingerprints(own, self.weigh(own), len(own), whole) for own in orders]
        self.prints = np.concatenate([*prints, np.empty((0, BITS // 8), np.uint8)])

    def shingles(self, own: np.ndarray) -> np.ndarray:
        """All shingles in order; of fewer words the whole sequence."""
        if len(own) >= self.words:
            return windows(own, np.array([len(own)]), self.words)[0]
        return shingles(own, np.array([len(own)]), self.words)[0]

    def weigh(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), self.unseen, np.int64)
        at, hit = _places(found, self.repeated)
        out[hit] = self.repeated_weights[at[hit]]
        return out

    @cached_property
    def marks(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle length: the sorted shingles, and behind the offsets of each the sizes of the items that have it."""
        owners: dict[int, set] = defaultdict(set)
        for j, size in enumerate(self.lengths.tolist()):
            owners[min(size, self.words)].update((s, size) for s in self.shares[self.bounds[j] : self.bounds[j + 1]].tolist())
        out = {}
        for width, pairs in owners.items():
            ordered = sorted(pairs)
            known, first = np.unique(np.array([s for s, _ in ordered], _U), return_index=True)
            out[width] = known, np.append(first, len(ordered)), np.array([size for _, size in ordered], np.int64)
        return out

    @cached_property
    def sizes(self) -> dict[int, tuple[np.ndarray, list]]:
        """Items and byte index by item size."""
        out = {}
        for size in np.unique(self.lengths).tolist():
            own = np.flatnonzero(self.lengths == size)
            out[size] = own, self._buckets(self.prints[own])
        return out

    @staticmethod
    def _buckets(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each byte: offsets by value, and the items whose byte is that value or at most ``FLIPS`` bits away."""
        out = []
        for column in prints.T:
            values = (column[:, None] ^ _NEAR).ravel()
            owners = np.repeat(np.arange(len(prints), dtype=np.int32), len(_NEAR))
            order = np.argsort(values, kind="stable")
            out.append((np.searchsorted(values[order], np.arange(257)), owners[order]))
        return out

    def within(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (fingerprint, item of this size) at most ``RADIUS`` bits apart."""
        items, buckets = self.sizes[size]
        own, codes = self.prints[items], np.empty(0, np.int64)
        for (offsets, owners), column in zip(buckets, prints.T, strict=True):
            first, n = offsets[column], offsets[column.astype(np.int64) + 1] - offsets[column]
            which = np.repeat(np.arange(len(prints)), n)
            spots = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            codes = np.unique(np.concatenate([codes, which * len(own) + owners[spots]]))
        window, item = codes // len(own), codes % len(own)
        near = distances(prints[window], own[item]) <= RADIUS
        return window[near], items[item[near]]

    def documents(self, hashed: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, list]]:
        """``(document, matches)`` for those of a run of documents that have a match."""
        spots: dict[tuple[int, int], list] = defaultdict(list)
        shingled = {}
        for width, (known, offsets, sizes) in self.marks.items():
            found, numbers = windows(hashed, counts, width)
            last = np.cumsum(numbers)
            shingled[width] = found, last - numbers, last
            at, hit = _places(found, known)
            hits = np.flatnonzero(hit)
            n = offsets[at[hits] + 1] - offsets[at[hits]]
            place = np.repeat(hits, n)
            size = sizes[np.repeat(offsets[at[hits]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            doc = np.searchsorted(last, place, side="right")
            for key, spot in zip(zip(doc.tolist(), size.tolist(), strict=True), (place - (last - numbers)[doc]).tolist(), strict=True):
                spots[key].append(spot)
        matches: dict[int, list] = defaultdict(list)
        for (doc, size), near in spots.items():
            found, first, last = shingled[min(size, self.words)]
            own = found[first[doc] : last[doc]]
            matches[doc] += self.matches(int(counts[doc]), own, size, np.array(near))
        for doc, found in sorted(matches.items()):
            if found:
                yield doc, sorted(found)

    def matches(self, n: int, found: np.ndarray, size: int, near: np.ndarray) -> list[tuple[int, int, float]]:
        """``(item, first word, similarity)`` of the best window of each item of ``size`` that reaches the threshold.

        ``found`` has the shingles of the document, of ``n`` words; windows hold one of those at ``near``.
        """
        length = min(size, n)
        span = length - min(size, self.words) + 1
        edge = np.zeros(n + 2, np.int32)
        np.add.at(edge, np.maximum(near - span + 1, 0), 1)
        np.add.at(edge, np.minimum(near, n - length) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: n - length + 1] > 0)
        weights = self.weigh(found)
        window, items = self.within(size, fingerprints(found, weights, span, starts))
        out = []
        for item in np.unique(items).tolist():
            best = self._best(found, weights, span, item, starts[window[items == item]])
            if best:
                out.append((self.ids[item], best[0], best[1]))
        return out

    def _best(
        self, found: np.ndarray, weights: np.ndarray, span: int, item: int, starts: np.ndarray
    ) -> tuple[int, float] | None:
        """The first of the windows at ``starts`` that are most like the item, and its similarity.

        Running sums bound each window's similarity from above; those that may reach the threshold are counted.
        """
        share = slice(self.bounds[item], self.bounds[item + 1])
        numbers, worth = self.numbers[share], self.weights[share]
        whole = int((worth * numbers).sum())
        at, hit = _places(found, self.shares[share])

        def sums(values: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
            return run[span:] - run[:-span]

        both = sums(weights) + whole
        most = np.minimum(sums(weights * hit), whole)
        starts = starts[100 * most[starts] >= self.percent * (both - most)[starts]]
        bounds = most[starts] / (both - most)[starts]
        best = None
        for k in np.argsort(-bounds, kind="stable").tolist():
            if best and bounds[k] < best[1]:
                break
            start = int(starts[k])
            shared = at[start : start + span][hit[start : start + span]]
            common = int((np.minimum(np.bincount(shared, minlength=len(numbers)), numbers) * worth).sum())
            united = int(both[start]) - common
            if 100 * common >= self.percent * united:
                rank = (common / united, -start)
                if best is None or rank > (best[1], -best[0]):
                    best = start, rank[0]
        return best


def _lookup(index) -> object:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("similarity", pa.float64())]))

    @F.arrow_udf(MATCH)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = index.value
        for texts in batches:
            out: list = [[]] * len(texts)
            for row, counts, hashed in hashed_words(texts, lower=True):
                for doc, hits in items.documents(hashed, counts):
                    out[row + doc] = [dict(zip(("item_id", "start", "similarity"), h, strict=True)) for h in hits]
            yield pa.array(out, kind)

    return found


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each text."""
    for batch in batches:
        found = [np.empty(0, _U)]
        for _, counts, hashed in hashed_words(batch["text"], lower=True):
            found += [own for own, n in zip(shingles(hashed, counts, WORDS), counts.tolist(), strict=True) if n]
        yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])


def _repeated(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles that more than one item has, and how many have each."""
    found = rows.select("text").mapInArrow(lean(_shingles_of), "shingle long")
    times = found.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1").toArrow()
    seen = times["shingle"].to_numpy().view(_U)
    order = np.argsort(seen)
    return seen[order], times["times"].to_numpy()[order]


def search_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks of items, and one index after the other.

    Items are a stated query set. Their words are counted first; up to ``MAX_BLOCK_WORDS`` of them make a
    block whose index is built on the driver and broadcast. Weights follow from all items: of several blocks each
    gets the shingles that more than one item has, counted by one aggregate. Items without words, or with a null id,
    match nothing.
    """
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(
        "item_id is not null"
    )
    words = F.size(words_of(F.col("text")))
    size, number = rows.agg(F.coalesce(F.sum(words), F.lit(0)), F.count(F.when(words > 0, 1))).first()
    blocks = -(-size // MAX_BLOCK_WORDS)

    def indexes() -> Iterator[Broadcast]:
        among = (number, *_repeated(rows)) if blocks > 1 else None
        for b in range(blocks):
            block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toArrow()
            index = ItemIndex(block["item_id"].to_pylist(), block["text"].to_pylist(), among=among)
            yield spark.sparkContext.broadcast(index)

    return blocks, indexes()


def _written_blocks(indexes: Iterator[Broadcast], answer: Callable[[Callable], DataFrame]) -> DataFrame:
    """The answers of all blocks. One block is held at a time, and its answer is written."""
    parts = []
    for index in indexes:
        parts.append(written(answer(_lookup(index)), "matches"))
        index.destroy()
    return reduce(DataFrame.unionByName, parts)


def find_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, start, similarity``: for each document and item the best window that matches.

    Found are windows whose fingerprint is at most ``RADIUS`` of 128 bits from the item's; one of similarity 0.75 is
    about 20 bits away.

    ``start`` is the window's first word, from 0, the first of equally good ones; a document shorter than
    the item is one window. Similarity is the weight of the common 5-word shingles over that of all, each as
    often as it occurs; 0.75 or more matches. A-Z is folded. Null and blank texts match nothing; rows with
    null or repeated keys are searched like others; without documents or items the result is empty. It is a
    projection for each block of items: no shuffle. Items with the same id are items of their own.
    """

    def answer(found: Callable) -> DataFrame:
        hits = docs.select(F.col(key).alias("doc_id"), F.explode(found(F.col(text))).alias("hit"))
        return hits.select("doc_id", "hit.item_id", "hit.start", "hit.similarity")

    blocks, indexes = search_blocks(items)
    if not blocks:
        return answer(lambda _: F.array().cast(MATCH))
    return answer(_lookup(next(indexes))) if blocks == 1 else _written_blocks(indexes, answer)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, in which no item is found.

    One block of items is a projection; of several, each writes the digests of the texts that have a match, and
    rows with such a text go by one join. Null and blank texts stay, of repeated rows all stay or go, columns of any
    name are kept, and without documents or items nothing changes.
    """
    blocks, indexes = search_blocks(items)
    if not blocks:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if blocks == 1:
        found = docs.select(row, _lookup(next(indexes))(F.col(text)).alias("hits"))
        return found.where(F.size("hits") == 0).select(*kept)
    digest = F.sha2(F.col(text), 256).alias("digest")

    def matched(found: Callable) -> DataFrame:
        hits = docs.select(digest, found(F.col(text)).alias("hits"))
        return hits.where(F.size("hits") > 0).select("digest").distinct()

    gone = _written_blocks(indexes, matched).distinct()
    return docs.select(row, digest).join(gone, "digest", "left_anti").select(*kept)
