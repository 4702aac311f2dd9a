"""Self-join of documents by the Jaccard similarity of their word shingles, as connected groups.

Prefixes with several matches: if the tokens of two sets stand in one order, rare first, then sets that share
``c`` tokens share ``m`` of them within their first ``size - c + m``. A document whose tokens are common takes a
longer prefix and asks for more matches, whichever its estimated cost makes cheapest; a pair goes by the smaller
``m`` of its two documents. The steps:

1. One pass over the texts: size and digest of each document's set, and counts of all tokens in a fixed
   number of buckets. Documents with equal sets become one class with its smallest key.
2. A second pass: every document's prefix tokens, dealt by token in packed blocks. Tokens of one class only go.
3. Every class is compared with one well connected class (hub) that it shares prefix tokens with. Those similar to
   the same hub are one group already, so thousands of near copies need one comparison each.
4. Other classes under the same hub are paired by the tokens in which they differ from it (``_pairs_by_difference``).
5. Classes under different hubs are paired by prefix tokens. A pair must pass the size filter, the bound from
   unmatched tokens and the number of matches before its sets are compared.
6. Connected components over the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, written
from .hashing import hashed_words, lean, shingles

WORDS = 5
PERCENT = 75
#: Token counts are kept for so many buckets: 2 MB for the driver and each executor, at any input size.
BUCKETS = 1 << 18
#: Numbers of matches that a document may ask for.
MATCHES = (1, 2, 3, 4, 6, 8)
#: Cost of a comparison of two sets, as that of one posting is 1.
VERIFY_COST = 20.0
#: Classes to compare that may be sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Prefix tokens that a task gathers before it hands them on.
FLUSH = 1_000_000

_U = np.uint64
_LOW56 = _U((1 << 56) - 1)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[object, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    for row, counts, hashes in hashed_words(batch.column(1), lower=True):
        for k, tokens in enumerate(shingles(hashes, counts, words)):
            yield ids[row + k], tokens


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    half = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(half[0]), int(half[1])


def _bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)


def _describe(words: int):
    """Rows of documents (``n, key, key2``; keys null for empty sets), then rows of bucket counts."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("bucket", pa.int32()), ("weight", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, size = np.zeros(BUCKETS, np.int64), [np.empty(0, _U)], 0
        for batch in batches:
            rows = []
            for doc, tokens in _sets(batch, words):
                rows.append((doc, len(tokens), *(_digest(tokens) if len(tokens) and doc is not None else (None, None))))
                held.append(tokens)
                size += len(tokens)
                if size >= FLUSH:
                    weights += _bucket_counts(held)
                    held, size = [np.empty(0, _U)], 0
            if rows:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns]
                nulls = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays([*arrays, nulls.cast(pa.int32()), nulls.cast(pa.int64())], schema=schema)
        weights += _bucket_counts(held)
        used = np.flatnonzero(weights)
        nulls = pa.nulls(len(used)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nulls, nulls, nulls, nulls, pa.array(used.astype(np.int32)), pa.array(weights[used])], schema=schema
        )

    return lean(run)


def allowed(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` may lack of a similar one: ``n`` less the least overlap."""
    return n - (percent * n + 99) // 100


def _choose(n: int, costs: np.ndarray, percent: int) -> int:
    """Matches to ask for: postings read plus expected candidates (at most postings / matches) to verify."""
    sums = np.cumsum(costs[: allowed(n, percent) + MATCHES[-1]])
    if not len(sums) or sums[-1] == 0:
        return 1
    best, least = 1, None
    for m in MATCHES:
        length = allowed(n, percent) + m
        if length > n:
            break
        cost = sums[length - 1] * (1 + VERIFY_COST / m)
        if least is None or cost < least:
            best, least = m, cost
    return best


def _prefixes(words: int, percent: int, weights: np.ndarray, parts: int):
    """Blocks ``(part, block)`` of prefix postings: token, key and position with matches, as packed arrays.

    A token's place in the order is in its top byte: the logarithm of its bucket's count.
    """
    mean = max(1.0, float(weights.mean()))
    rank = np.clip(np.round(16 * np.log2(np.maximum(weights, 1) / mean)) + 32, 0, 255).astype(_U) << _U(56)
    expected = np.maximum(0.0, weights - mean - 3 * np.sqrt(mean))
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, size = [], 0
        for batch in batches:
            for doc, tokens in _sets(batch, words):
                if doc is None or not len(tokens):
                    continue
                digest = _digest(tokens)
                if digest in seen:
                    continue
                seen.add(digest)
                ordered = np.sort(rank[(tokens & _U(BUCKETS - 1)).astype(np.int64)] | (mix_out(tokens) & _LOW56))
                costs = expected[bucket_of(ordered)]
                matches = _choose(len(tokens), costs, percent)
                length = min(len(tokens), allowed(len(tokens), percent) + matches)
                places = np.arange(1, length + 1, dtype=np.uint32) | np.uint32(matches << 28)
                held.append((ordered[:length], np.full(length, digest[0], np.int64), places))
                size += length
                if size >= FLUSH:
                    yield _blocks(held, parts, schema)
                    held, size = [], 0
        if held:
            yield _blocks(held, parts, schema)

    return lean(run)


def mix_out(tokens: np.ndarray) -> np.ndarray:
    """Tokens with their bucket bits on top of the lower 56, so that the bucket survives the rank byte."""
    return (tokens << _U(38)) | ((tokens >> _U(18)) & _U((1 << 38) - 1))


def bucket_of(ordered: np.ndarray) -> np.ndarray:
    return ((ordered >> _U(38)) & _U(BUCKETS - 1)).astype(np.int64)


def _blocks(held: list, parts: int, schema: pa.Schema) -> pa.RecordBatch:
    tokens, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
    part = ((tokens * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) % parts
    order = np.lexsort((tokens, part))
    tokens, keys, places, part = tokens[order], keys[order], places[order], part[order]
    ends = np.searchsorted(part, np.arange(parts), side="right")
    numbers, blocks, begin = [], [], 0
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            # The 16 lowest bits of a token are left out: a match by chance is found out when sets are compared.
            short = (tokens[begin:end] >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            planes = np.ascontiguousarray(short.T).tobytes()
            spots = np.ascontiguousarray(places[begin:end].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            numbers.append(k)
            blocks.append(planes + spots + keys[begin:end].astype("<i8").tobytes())
            begin = end
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], schema=schema)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(block) // 18
    raw = np.frombuffer(block, np.uint8)
    tokens = np.zeros((n, 8), np.uint8)
    tokens[:, :6] = raw[: 6 * n].reshape(6, n).T
    places = np.ascontiguousarray(raw[6 * n : 10 * n].reshape(4, n).T)
    return tokens.view("<i8").ravel(), places.view("<u4").ravel(), np.frombuffer(block, "<i8", n, 10 * n)


@lean
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings whose token occurs in the prefixes of two classes or more, each class once."""
    held = [_unpack(block) for batch in batches for block in batch.column(1).to_pylist()]
    if not held:
        return
    tokens, places, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.lexsort((keys, tokens))
    tokens, places, keys = tokens[order], places[order], keys[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, places, keys = tokens[fresh], places[fresh], keys[fresh]
    same = tokens[1:] == tokens[:-1]
    shared = np.zeros(len(tokens), bool)
    shared[1:] |= same
    shared[:-1] |= same
    tokens, places, keys = tokens[shared], places[shared], keys[shared]
    for low in range(0, len(tokens), 100_000):
        high = low + 100_000
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(tokens[low:high]),
                pa.array(keys[low:high]),
                pa.array((places[low:high] & np.uint32((1 << 28) - 1)).astype(np.int32)),
                pa.array((places[low:high] >> np.uint32(28)).astype(np.int32)),
            ],
            names=["token", "key", "place", "matches"],
        )


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = list(_sets(batch, words))
            for low in range(0, len(held), 256):
                tokens = [t for _, t in held[low : low + 256]]
                keys = [_digest(t)[0] for t in tokens]
                sets = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), pa.int32()),
                    pa.array(np.concatenate(tokens).view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), sets], names=["key", "tokens"])

    return lean(run)


def _compared(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``pairs`` (``a``, ``b``: keys) with their whole sets ``x``, ``y`` and common tokens ``o``.

    Only the documents of the pairs are read.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = written(classes.join(keys, "key", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "compared")
    small = ids.count() <= MAX_BROADCAST_ROWS
    chosen = texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    sets = written(chosen.mapInArrow(_set_rows(words), "key long, tokens array<long>"), "sets").dropDuplicates(["key"])
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("x", "y")))


def _similar(o: Column, n: Column, k: Column, percent: int) -> Column:
    return 100 * o >= percent * (n + k - o)


def _least_overlap(n: Column, k: Column, percent: int) -> Column:
    """The least common tokens of sets of ``n`` and ``k`` that are similar."""
    return F.ceil(percent * (n + k) / F.lit(100 + percent)).cast("int")


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A-Z is folded; a document's set is its distinct ``words``-word shingles, of a shorter text the whole
    sequence. Documents link at ``100 * common >= percent * united``; ``component_id`` is the smallest key
    reachable by links, the own one included. Texts without words, or null, have 0 shingles and link with
    nothing. Rows with a null key have a null component and link with nothing. Repeated rows are all
    returned; an empty table gives an empty result. Keys must be whole numbers. Other columns are not read.
    """
    return _grouped(docs, key, text, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``similar_groups`` with ``n``, the digest of the set, ``key, key2``, and a ``group`` that no two groups share."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = written(
        texts.mapInArrow(_describe(words), "doc_id long, n long, key long, key2 long, bucket int, weight long"),
        "described",
    )
    rows = described.where("bucket is null").select("doc_id", "n", "key", "key2")
    counted = described.where("bucket is not null").groupBy("bucket").agg(F.sum("weight").alias("weight")).toArrow()
    weights = np.zeros(BUCKETS, np.int64)  # from a fixed number of rows
    weights[counted["bucket"].to_numpy()] = counted["weight"].to_numpy()

    classes = written(
        rows.where("key is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n")),
        "classes",
    )
    links = _links(texts, classes, weights, words, percent, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = components(links).select(F.col("node").alias("key"), F.col("component").alias("group"))
    grouped = classes.join(found, "key", "left").withColumn("group", F.coalesce("group", "key"))
    lowest = grouped.groupBy("group").agg(F.min("doc").alias("component"))
    labelled = grouped.join(lowest, "group").select("key", "key2", "group", "component")
    return rows.join(labelled, ["key", "key2"], "left").select(
        "doc_id",
        "n",
        "key",
        "key2",
        "group",
        F.coalesce("component", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and texts with the digest of the text's set, null without words."""
    for batch in batches:
        found = [_digest(tokens) if len(tokens) else (None, None) for _, tokens in _sets(batch, WORDS)]
        halves = [pa.array([f[i] for f in found], pa.int64()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *halves], names=["doc_id", "text", "key", "key2"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, but of each group only the one with the smallest key.

    Of rows equal in key and text one stays. A key with several texts stands for each of them: each is judged by its
    own group, and of those that have the smallest key of one group the least stays. Rows with a null key and texts
    without words are in no group and all stay.
    """
    grouped = written(_grouped(docs, key, text), "groups")
    several = written(grouped.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-keys")
    gone = grouped.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    if several.isEmpty():
        return docs.join(gone, key, "left_anti")
    named = several.select(F.col("doc_id").alias(key))
    own = docs.join(named, key, "left_semi")
    texts = own.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).distinct()
    texts = texts.mapInArrow(lean(_digests), "doc_id long, text string, key long, key2 long")
    first = grouped.join(several, "doc_id", "left_semi").where("n > 0 and component_id = doc_id")
    first = first.select("doc_id", "key", "key2", "group").distinct()
    chosen = texts.join(first, ["doc_id", "key", "key2"]).groupBy("doc_id", "group").agg(F.min("text").alias("text"))
    chosen = written(chosen.select("doc_id", "text").union(texts.where("key is null").select("doc_id", "text")), "chosen")
    same = (F.col(key) == F.col("__key")) & F.col(text).eqNullSafe(F.col("__text"))
    once = own.join(chosen.select(F.col("doc_id").alias("__key"), F.col("text").alias("__text")), same, "left_semi")
    alone = docs.join(named.union(gone), key, "left_anti")
    return alone.select(*docs.columns).union(once.dropDuplicates([key, text]).select(*docs.columns))


def _links(
    texts: DataFrame, classes: DataFrame, weights: np.ndarray, words: int, percent: int, parts: int
) -> DataFrame:
    """Verified links ``a``, ``b`` between classes, enough of them for the connected groups."""
    spark = texts.sparkSession
    run = _prefixes(words, percent, weights, parts)
    blocks = texts.mapInArrow(run, "part int, block binary").repartition("part")
    shared = blocks.mapInArrow(_shared, "token long, key long, place int, matches int")
    shared = written(shared, "shared")

    # Of the tokens before a place in the order, those that nobody shares are in no set that shares the token there.
    by_place = Window.partitionBy("key").orderBy("place")
    everything = Window.partitionBy("key")
    sizes = classes.select("key", F.col("n").cast("int").alias("n"))
    lacks = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    postings = (
        shared.join(sizes, "key")
        .withColumn("reach", (F.col("n") - (F.col("place") - F.row_number().over(by_place))).cast("int"))
        .withColumn("alone", (lacks + F.col("matches") - F.count("*").over(everything)).cast("int"))
        .select("token", "key", "n", "place", "matches", lacks.cast("int").alias("lacks"), "reach", "alone")
    )
    postings = written(postings, "postings")

    # Hubs: of each token the class with the fewest unshared prefix tokens; of each class the hub that most
    # classes meet. A hub met at few tokens would not be similar; leaving it out here loses nothing.
    rank = F.struct(-F.col("alone"), -F.col("key"))
    hubs = postings.groupBy("token").agg(F.max_by(F.struct("key", "n"), rank).alias("h"))
    met = (
        postings.join(hubs, "token")
        .where((F.col("key") != F.col("h.key")) & (100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")))
        .groupBy("key", "lacks", F.col("h.key").alias("b"))
        .agg(F.count("*").alias("met"))
        .where(4 * F.col("met") >= F.col("lacks"))
    )
    met = written(met, "met")
    star = (
        met.join(met.groupBy("b").agg(F.count("*").alias("classes")), "b")
        .groupBy(F.col("key").alias("a"))
        .agg(F.max_by("b", F.struct("classes", "met", "b")).alias("b"))
    )
    star = written(_compared(texts, classes, written(star, "star"), words), "star-sets")
    n, k, o = F.size("x"), F.size("y"), F.col("o")
    star = star.select(
        F.col("a").alias("key"), F.col("b").alias("hub"), n.alias("n"), k.alias("n_hub"), "o",
        _similar(o, n, k, percent).alias("linked"),
        F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("differs"),
    )
    star_links = star.where("linked").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = _pairs_by_difference(star, percent)
    far = _pairs_by_prefix(postings, star.drop("differs", "n"), percent)
    candidates = written(near.union(far).distinct(), "candidates")
    found = _compared(texts, classes, candidates, words)
    return star_links.union(found.where(_similar(F.col("o"), F.size("x"), F.size("y"), percent)).select("a", "b"))


def _sides(rows: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """The rows twice, with all columns but those of the join named ``_a`` and ``_b``."""
    named = [c for c in rows.columns if c not in on]
    return tuple(rows.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in named]) for side in "ab")


def _needed(percent: int) -> Column:
    """Tokens that the differences of two classes from one hub must share if the classes are similar.

    With ``d`` the difference from hub ``h``, ``|a & b| = |h| - |h - a| - |h - b| + |d(a) & d(b)|``.
    """
    return _least_overlap(F.col("n_a"), F.col("n_b"), percent) + F.col("n_hub_a") - F.col("o_a") - F.col("o_b")


def _pairs_by_difference(star: DataFrame, percent: int) -> DataFrame:
    """Pairs under one hub, not both linked to it, that may be similar.

    Near copies differ from their hub at places of their own, so their differences share little where the sets
    share nearly everything: prefixes of the differences, rare tokens first, hardly ever meet.
    """
    rows = star.select("hub", "key", "n", "n_hub", "o", "linked", F.size("differs").alias("d"), F.explode("differs").alias("t"))
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("hub", "t")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("hub", "key").orderBy("df", "t")))
    x, y = _sides(written(rows.where("df > 1").drop("df"), "differences"), "hub", "t")
    needed = _needed(percent)
    return (
        x.join(y, ["hub", "t"])
        .where(
            (F.col("key_a") < F.col("key_b"))
            & ~(F.col("linked_a") & F.col("linked_b"))
            & (needed > 0)
            & (F.col("place_a") <= F.col("d_a") - needed + 1)
            & (F.col("place_b") <= F.col("d_b") - needed + 1)
            & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        )
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        .distinct()
    )


def _pairs_by_prefix(postings: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """All other pairs that share enough prefix tokens to be similar."""
    rows = postings.join(star, "key", "left").drop("alone")
    x, y = _sides(written(rows, "tagged"), "token")
    fewer = F.least("matches_a", "matches_b")
    overlap = _least_overlap(F.col("n_a"), F.col("n_b"), percent)
    by_difference = (F.col("hub_a") == F.col("hub_b")) & ((F.col("linked_a") & F.col("linked_b")) | (_needed(percent) > 0))
    met = x.join(y, "token").where(
        (F.col("key_a") < F.col("key_b"))
        & ~F.coalesce(by_difference, F.lit(False))
        & (F.col("place_a") <= F.col("lacks_a") + fewer)
        & (F.col("place_b") <= F.col("lacks_b") + fewer)
        & (F.least("reach_a", "reach_b") >= overlap)
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    )
    rest = F.greatest(F.col("n_a") - F.col("lacks_a"), F.col("n_b") - F.col("lacks_b")) - F.col("fewer")
    sizes = ("n_a", "n_b", "lacks_a", "lacks_b")
    return (
        met.groupBy("key_a", "key_b")
        .agg(F.count("*").alias("met"), F.first(fewer).alias("fewer"), *[F.first(c).alias(c) for c in sizes])
        .where((F.col("met") >= F.col("fewer")) & (F.col("met") + rest >= overlap))
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    )
