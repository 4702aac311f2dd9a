"""How much the sources of a language diverge: in kept terms, and from each other.

A language's kept terms, in byte order, become minimal acyclic transducers from term to lexicographic ordinal. The texts
are then streamed through them, which gives the counts; from there on terms are numbers, and ordinals break ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_runs import LETTERS, LOWER, byte_runs
from .common import numbered, written
from .hashing import lean
from .transducer import Transducer, minimal

MIN_DOCS = 3
#: Terms of a report's source and language.
TOP = 200
#: Terms of a transducer, and transducers that the executors hold at once.
BLOCK = 1 << 14
PACK = 128
#: Terms whose counts in all sources are compared together.
SPAN = 1 << 12
SCALE = 1_000_000_000


def _batch_names(batch: pa.RecordBatch, *columns: str) -> list[tuple[np.ndarray, list]]:
    """For each column the number of each row's value, and the values; null is the empty string."""
    out = []
    for name in columns:
        coded = pc.fill_null(batch[name].cast(pa.string()), "").dictionary_encode()
        out.append((coded.indices.to_numpy(), coded.dictionary.to_pylist()))
    return out


def _term_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, term, docs``: in how many texts of a run a term is."""
    for batch in batches:
        ((codes, names),) = _batch_names(batch, "lang")
        seen: set = set()
        for row, piece, counts, words in byte_runs(batch["text"], LETTERS, LOWER):
            coded = words.dictionary_encode()
            terms, size = coded.dictionary, max(1, len(coded.dictionary))
            if piece >= 0:
                seen = seen if piece else set()
                fresh = [t for t in terms.to_pylist() if t not in seen]
                seen.update(fresh)
                yield _documents([names[codes[row]]] * len(fresh), pa.array(fresh, pa.binary()), np.ones(len(fresh), np.int64))
                continue
            code = coded.indices.to_numpy().astype(np.int64)
            each = np.unique(np.repeat(np.arange(len(counts)), counts) * size + code)
            pairs, docs = np.unique(codes[row + each // size] * size + each % size, return_counts=True)
            yield _documents([names[k] for k in (pairs // size).tolist()], terms.take(pa.array(pairs % size)), docs)


def _documents(langs: list, terms: pa.Array, docs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(langs, pa.string()), terms, pa.array(docs, pa.int64())], ["lang", "term", "docs"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, ordinal``: terms (UTF-8) in at least ``min_docs`` rows of a language, numbered in byte order from 0."""
    found = docs.select("lang", "text").mapInArrow(lean(_term_documents), "lang string, term binary, docs long")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    placed = numbered(written(kept.select("lang", "term"), "terms"), ["lang"], ["term"])
    return written(placed.select("lang", "term", F.col("place").alias("ordinal")), "vocabulary")


def _built(group: pa.Table) -> pa.Table:
    group = group.sort_by("term")
    blob = minimal(group["term"].to_pylist()).to_bytes()
    first = pc.min(group["ordinal"]).as_py()
    return pa.table({"lang": group["lang"][:1], "block": group["block"][:1], "first": [first], "blob": pa.array([blob], pa.binary())})


def transducers(terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, block, first, blob, place``: a transducer for each ``block`` terms; ``first`` is added to its ordinals."""
    cut = terms.withColumn("block", F.floor(F.col("ordinal") / F.lit(block)))
    built = cut.groupBy("lang", "block").applyInArrow(_built, "lang string, block long, first long, blob binary")
    return written(numbered(written(built, "transducers"), [], ["lang", "block"]), "transducers")


def _recount(blobs):
    """``lang, source, ordinal, n``: how often a source's texts of a run have a term of these transducers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict[str, list] = {}
        for lang, first, blob in blobs.value:
            machines.setdefault(lang, []).append((first, Transducer.from_bytes(blob)))
        for batch in batches:
            (langs, lang_names), (sources, source_names) = _batch_names(batch, "lang", "source")
            parts = [np.empty((3, 0), np.int64)]
            for row, _, counts, words in byte_runs(batch["text"], LETTERS, LOWER):
                own = slice(row, row + len(counts))
                groups, group = np.unique(langs[own].astype(np.int64) * len(source_names) + sources[own], return_inverse=True)
                coded = words.dictionary_encode()
                terms, size = coded.dictionary, max(1, len(coded.dictionary))
                code = np.repeat(group, counts) * size + coded.indices.to_numpy()
                pairs, times = np.unique(code, return_counts=True)
                of, term = groups[pairs // size], pairs % size
                for k in np.unique(of // len(source_names)).tolist():
                    here = np.flatnonzero(of // len(source_names) == k)
                    # A term is streamed once, whatever the number of sources that have it.
                    asked, spot = np.unique(term[here], return_inverse=True)
                    mine = terms.take(pa.array(asked))
                    for first, machine in machines.get(lang_names[k], ()):
                        found = machine.ordinals(mine)[spot]
                        hit = np.flatnonzero(found >= 0)
                        parts.append(np.stack([of[here[hit]], found[hit] + first, times[here[hit]]]))
            of, ordinal, times = np.concatenate(parts, axis=1)
            order = np.lexsort((ordinal, of))
            of, ordinal, times = of[order], ordinal[order], times[order]
            heads = np.flatnonzero(np.diff(of, prepend=-1).astype(bool) | np.diff(ordinal, prepend=-1).astype(bool))
            columns = {
                "lang": pa.array(lang_names, pa.string()).take(pa.array(of[heads] // max(1, len(source_names)))),
                "source": pa.array(source_names, pa.string()).take(pa.array(of[heads] % max(1, len(source_names)))),
                "ordinal": pa.array(ordinal[heads]),
                "n": pa.array(np.add.reduceat(times, heads) if len(heads) else times),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return count


def recounted(docs: DataFrame, machines: DataFrame, pack: int = PACK) -> DataFrame:
    """``lang, source, ordinal, n`` of all kept terms, by streaming the texts through the transducers.

    At most ``pack`` transducers go to the executors at once; a larger vocabulary takes a pass over the texts for each
    such number of them.
    """
    spark = docs.sparkSession
    number = machines.agg(F.count("*")).first()[0]
    parts = []
    for low in range(0, max(number, 1), pack):
        rows = machines.where((F.col("place") >= low) & (F.col("place") < low + pack)).select("lang", "first", "blob").collect()
        blobs = spark.sparkContext.broadcast([(r.lang, r["first"], bytes(r.blob)) for r in rows])
        found = docs.mapInArrow(lean(_recount(blobs)), "lang string, source string, ordinal long, n long")
        parts.append(written(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount"))
        blobs.destroy()
    return reduce(DataFrame.unionByName, parts)


def scaled_share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 * count / total)``, exactly."""
    part = (count.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", part, total.cast("decimal(38,0)")) + F.lit(1)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same over arrays: three decimal digits at a time, so that nothing overflows below 9e15."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def _compared(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """For each two sources of a language the sum of ``(p - q)^2 // q`` over a span of terms."""
    names = groups["source"].to_pylist()
    number = {name: k for k, name in enumerate(names)}
    if not len(counts):
        names = []
    terms, term = np.unique(counts["ordinal"].to_numpy() if names else np.empty(0, np.int64), return_inverse=True)
    seen = np.ones((len(names), len(terms)), np.int64)
    if names:
        coded = counts["source"].combine_chunks().dictionary_encode()
        rows = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        np.add.at(seen, (rows, term), counts["n"].to_numpy())
        shares = _shares(seen, (groups["total"].to_numpy() + groups["terms"].to_numpy())[:, None])
    sums = [((shares[a] - shares) ** 2 // shares).sum(axis=1) for a in range(len(names))]
    lang = groups["lang"][0].as_py() if len(groups) else ""
    n = len(names) ** 2
    return pa.table(
        {
            "lang": pa.array([lang] * n, pa.string()),
            "source": pa.array([a for a in names for _ in names], pa.string()),
            "item": pa.array(names * len(names), pa.string()),
            "value": pa.array(np.concatenate(sums) if sums else [], pa.int64()),
        }
    )


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every language and source of ``docs``.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z folded; null ``lang``, ``source`` and ``text`` count as
    empty. A language keeps the terms in at least ``min_docs`` of its rows. A group's share of a term is
    ``1 + floor(10^9 (count + 1) / (all its counts + kept terms))``. Part ``pair`` has each other source of the language
    with the sum of ``(p - q)^2 // q`` over the kept terms, ``p`` the group's share and ``q`` the other's; part ``term`` has
    the ``top`` terms the group uses more than its language as a whole, with that value. Ties of values go by the item's
    bytes. Each row counts as a document of its own, also a repeated one; texts of any length are read whole; an
    empty table gives an empty result, and a language of one source and no kept term no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = written(rows.select("lang", "source").distinct(), "groups")
    terms = kept_terms(rows, min_docs)
    counts = recounted(rows, transducers(terms))

    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "terms"]), "groups")
    best = _divergent_terms(counts, groups, top).join(terms, ["lang", "ordinal"])
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return best.unionByName(_pairs(counts, groups))


def _divergent_terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``lang, source, ordinal, value, rank``. Each task cuts its rows to the first ``top`` of a group before they meet."""
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    both = counts.join(whole, ["lang", "ordinal"]).join(groups, ["lang", "source"]).join(langs, "lang")
    p = scaled_share(F.col("n") + 1, F.col("total") + F.col("terms"))
    q = scaled_share(F.col("lang_n") + 1, F.col("lang_total") + F.col("terms"))
    both = both.select("lang", "source", "ordinal", p.alias("p"), q.alias("q")).where("p > q")
    both = both.withColumn("value", F.expr("(p - q) * (p - q) div q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("p", "q")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    cut = counts.withColumn("span", F.floor(F.col("ordinal") / F.lit(SPAN)))
    spans = groups.select("lang", "terms", "source", "total").withColumn(
        "span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / F.lit(SPAN))))
    )
    sums = (
        cut.groupBy("lang", "span")
        .cogroup(spans.groupBy("lang", "span"))
        .applyInArrow(_compared, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
