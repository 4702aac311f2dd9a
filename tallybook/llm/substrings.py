"""Removal of word sequences that occur more than once, within a document or across documents.

Level-wise doubling: windows of 9 words are counted, those repeated are extended to 18 words and counted
again, and so on; the last step ends at the asked length (35). Windows longer than that need no level: they consist
of windows of the asked length, so no candidate is left undecided.

Below the asked length only chosen windows travel: of the short windows in each asked-length window the one with the
least hash, leftmost among equals. The choice depends on the words alone, so equal windows choose alike, and a window
whose choice is not repeated is not repeated. At the asked length all windows still alive travel, those in a row with
the same choice as one run, to the task of that choice; so a run has its document and place once.

Equal texts are settled beforehand: they repeat each other whole, and one of them stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import hashed_words, lean, windows

WORDS = 35
FIRST = 9
#: Rows (keys of texts) that may be sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Windows that a task gathers before it hands them on.
FLUSH = 1_000_000
#: Words whose choices are made at once; places within it take 24 bits of a packed number.
SEGMENT = 1 << 22

_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def levels(words: int, first: int = FIRST) -> list[int]:
    """Window lengths below ``words``, each at most twice the one before, and the last at least half of it."""
    out = [min(first, words)]
    while 2 * out[-1] < words:
        out.append(2 * out[-1])
    return out


def _choices(short: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` numbers the place of its least one, leftmost of equals."""
    out = np.empty(max(0, len(short) - span + 1), np.int64)
    for low in range(0, len(out), SEGMENT):
        part = short[low : low + SEGMENT + span - 1]
        packed = (part & ~_PLACE) | np.arange(len(part), dtype=_U)
        width = 1
        while 2 * width <= span:
            packed = np.minimum(packed[:-width], packed[width:])
            width *= 2
        if width < span:
            packed = np.minimum(packed[: len(packed) - (span - width)], packed[span - width :])
        out[low : low + len(packed)] = (packed & _PLACE).astype(np.int64) + low
    return out


def _candidates(batch: pa.RecordBatch, words: int, length: int, before: int | None):
    """For each text ``(key, hashes, places of live windows, their choices)``.

    ``length`` is the size of the chosen windows. With ``before`` the third column has the places of the
    chosen windows of that size that are repeated, and only windows that chose one of them are alive.
    """
    keys = batch.column(0).to_pylist()
    for row, counts, hashed in hashed_words(batch.column(1)):
        at = 0
        for k, n in enumerate(counts.tolist()):
            own, at = hashed[at : at + n], at + n
            if n < words:
                continue
            size = np.array([n])
            alive = np.arange(n - words + 1)
            if before is not None:
                repeated = np.zeros(n, bool)
                repeated[np.asarray(batch.column(2)[row + k].values)] = True
                alive = np.flatnonzero(repeated[_choices(windows(own, size, before)[0], words - before + 1)])
            short = windows(own, size, length)[0]
            chosen = _choices(short, words - length + 1)[alive]
            yield keys[row + k], own, short, alive, chosen


def _short_windows(words: int, length: int, before: int | None, parts: int):
    """Blocks of chosen windows: hash, place, key."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            for key, _, short, _, chosen in _candidates(batch, words, length, before):
                if key in seen:
                    continue
                seen.add(key)
                places = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
                held.append((short[places], places.astype(np.uint32), np.full(len(places), key, np.int64)))
                size += len(places)
                if size >= FLUSH:
                    yield _blocks(held, parts, schema)
                    held, size = [], 0
        if held:
            yield _blocks(held, parts, schema)

    return lean(run)


def _blocks(held: list, parts: int, schema: pa.Schema) -> pa.RecordBatch:
    hashes, places, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (hashes >> _U(40)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts), side="right").tolist()
    numbers, blocks, begin = [], [], 0
    for k, end in enumerate(ends):
        if end > begin:
            own = order[begin:end]
            numbers.append(k)
            blocks.append(hashes[own].tobytes() + places[own].tobytes() + keys[own].tobytes())
            begin = end
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], schema=schema)


def _again(hashes: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which entries have a hash that another key or place has too."""
    order = np.lexsort((places, keys, hashes))
    h, k, p = hashes[order], keys[order], places[order]
    same = h[1:] == h[:-1]
    other = np.zeros(len(h), bool)
    # In a group of equal hashes: is any neighbour another occurrence?
    change = same & ((k[1:] != k[:-1]) | (p[1:] != p[:-1]))
    group = np.cumsum(np.concatenate([[0], ~same])) if len(h) else np.zeros(0, np.int64)
    several = np.bincount(group[1:][change], minlength=int(group[-1]) + 1 if len(h) else 0) > 0
    other[order] = several[group]
    return other


@lean
def _repeated_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        for block in batch.column(1).to_pylist():
            n = len(block) // 20
            held.append(
                (np.frombuffer(block, _U, n), np.frombuffer(block, np.uint32, n, 8 * n), np.frombuffer(block, np.int64, n, 12 * n))
            )
    if not held:
        return
    hashes, places, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    found = _again(hashes, keys, places)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[found]), pa.array(places[found].astype(np.int32))], names=["key", "place"]
    )


def _runs(words: int, length: int, parts: int):
    """Blocks of live windows, by the choice they share: run lengths, starts, keys, then all hashes."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            for key, own, short, alive, chosen in _candidates(batch, words, length, length):
                if key in seen or not len(alive):
                    continue
                seen.add(key)
                whole = windows(own, np.array([len(own)]), words)[0][alive]
                begins = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(alive, prepend=-2) != 1))
                lengths = np.diff(begins, append=len(alive))
                part = (short[chosen[begins]] >> _U(40)).astype(np.int64) % parts
                held.append((part, lengths, alive[begins], np.full(len(begins), key, np.int64), whole))
                size += len(whole)
                if size >= FLUSH:
                    yield _run_blocks(held, schema)
                    held, size = [], 0
        if held:
            yield _run_blocks(held, schema)

    return lean(run)


def _run_blocks(held: list, schema: pa.Schema) -> pa.RecordBatch:
    part, lengths, starts, keys, whole = (np.concatenate(x) for x in zip(*held, strict=True))
    first = np.cumsum(lengths) - lengths
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    numbers, blocks = [], []
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[begin:end]
        n, size = len(own), lengths[own]
        spots = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        head = np.array([n], np.int64).tobytes() + size.astype(np.int32).tobytes() + starts[own].astype(np.int32).tobytes()
        numbers.append(int(part[order[begin]]))
        blocks.append(head + keys[own].tobytes() + whole[spots].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], schema=schema)


@lean
def _repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, start, stop``: windows from ``start`` up to, not including, ``stop`` occur elsewhere too."""
    held = []
    for batch in batches:
        for block in batch.column(1).to_pylist():
            n = int(np.frombuffer(block, np.int64, 1)[0])
            size = np.frombuffer(block, np.int32, n, 8)
            starts = np.frombuffer(block, np.int32, n, 8 + 4 * n)
            keys = np.frombuffer(block, np.int64, n, 8 + 8 * n)
            whole = np.frombuffer(block, _U, offset=8 + 16 * n)
            within = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
            held.append((whole, np.repeat(keys, size), np.repeat(starts, size) + within))
    if not held:
        return
    hashes, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
    found = _again(hashes, keys, places)
    keys, places = keys[found], places[found]
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    if not len(keys):
        return
    begin = np.flatnonzero((np.diff(keys, prepend=keys[0] - 1) != 0) | (np.diff(places, prepend=-2) > 1))
    last = np.append(begin[1:], len(keys)) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[begin]), pa.array(places[begin].astype(np.int32)), pa.array((places[last] + 1).astype(np.int32))],
        names=["key", "start", "stop"],
    )


def _small(rows: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def repeated_windows(texts: DataFrame, words: int = WORDS, first: int = FIRST) -> DataFrame:
    """Ranges of starts of repeated ``words``-word windows, for texts that have no equal.

    ``texts`` has ``key`` (long, equal for equal texts only) and ``text``, each text once. The result has
    ``key`` and ``ranges`` (array of ``start, stop``, in no order).
    """
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = levels(words, first)
    live, before = texts, None
    for length in steps:
        blocks = live.mapInArrow(_short_windows(words, length, before, parts), "part int, block binary")
        found = blocks.repartition("part").mapInArrow(_repeated_short, "key long, place int")
        places = written(found.groupBy("key").agg(F.collect_list("place").alias("places")), f"repeated-{length}")
        chosen = texts.join(_small(places.select("key")), "key", "left_semi")
        live, before = chosen.join(places, "key").select("key", "text", "places"), length
    blocks = live.mapInArrow(_runs(words, steps[-1], parts), "part int, block binary")
    found = blocks.repartition("part").mapInArrow(_repeated_runs, "key long, start int, stop int")
    ranges = found.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return written(ranges, f"repeated-{words}")


def _remove(words: int):
    schema = pa.schema(
        [("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            copied, ranges = batch.column(2).to_pylist(), batch.column(3)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[k].as_buffer()
                own = text.to_pybytes().split() if text is not None else []
                n = removed = len(own)
                if copied[k] and n >= words:
                    own = []
                elif ranges[k].is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    spans = ranges[k].values
                    np.add.at(edge, spans.field(0).to_numpy(), 1)
                    np.add.at(edge, spans.field(1).to_numpy() + words - 1, -1)
                    own = [w for w, c in zip(own, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                kept = b" ".join(own)
                size += len(kept)
                out.append((doc, n, removed - len(own), kept.decode()))
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return lean(run)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, first: int = FIRST
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row of ``docs``.

    Each word is removed that lies in a window of ``words`` words whose sequence also starts at another
    place, in any row, the same one included. All occurrences go, and windows are judged on the input.
    Kept words are joined by one space. Words are parted by ASCII blanks and compared unchanged. Null and
    blank texts have no words and an empty ``kept_text``; texts of fewer than ``words`` words stay whole.
    Null and repeated keys are ordinary rows: rows with equal texts are copies. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text")).withColumn("key", F.xxhash64("text"))
    copies = written(
        rows.where("text is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("one")).where("n > 1"),
        "copies",
    )
    copies = _small(copies)
    marked = rows.join(copies, "key", "left")
    # One row of each group of copies takes part, for the sake of others that share passages with them.
    alone = marked.where("n is null or row is null or row = one").where("text is not null").select("key", "text")
    ranges = repeated_windows(alone, words, first)
    copied = F.col("n").isNotNull().alias("copied")
    none = F.lit(None).cast("array<struct<start:int,stop:int>>").alias("ranges")
    single = marked.where("n is null")
    small = _small(ranges.select("key"))
    whole = marked.join(small, "key", "left_anti").select("row", "text", copied, none)
    hit_copies = marked.where("n is not null").join(small, "key", "left_semi").select("row", "text", copied, none)
    hit = single.join(small, "key", "left_semi").join(ranges, "key").select("row", "text", copied, "ranges")
    out = whole.unionByName(hit_copies).unionByName(hit)
    return out.mapInArrow(_remove(words), "doc_id long, n_words long, n_removed long, kept_text string")
