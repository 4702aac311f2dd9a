"""The manifest against a plain one, its states against hashlib, and its answers to awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import common, merkle, sha_states

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string, digest string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climbed(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def runs(levels, at, fan):
    for below in levels[:-1]:
        yield below[at // fan * fan : at // fan * fan + fan], at % fan
        at //= fan


def plain(rows, fan):
    """All results, with whole runs hashed anew."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row[:5]), row))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda r: r[:3])
    grown = {lang: climbed([r[2] for r in trees[lang]], fan) for lang in order}
    top = climbed([grown[lang][-1][0] for lang in order], fan)
    out = []
    for k, lang in enumerate(order):
        for i, (_, _, own, row) in enumerate(trees[lang]):
            more = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            now, siblings = leaf(*row[:4], row[4] + 1) if more else own, []
            for run, slot in [*runs(grown[lang], i, fan), *runs(top, k, fan)]:
                siblings += run[:slot] + run[slot + 1 :]
                now = digest(*run[:slot], now, *run[slot + 1 :])
            out.append((row[0], own, grown[lang][-1][0], top[-1][0], digest(*siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


def row(i, text="words of a text", lang="en", source="s", n=7):
    return (i, text, lang, source, n, "x", "y", "z")


ROWS = [row(i, f"text {i}", lang) for lang, n in (("en", 23), ("de", 8), ("fr", 1), ("ü", 5)) for i in range(n)]
ODD = [
    row(None, None, None, None, None), row(None, "no id"), row(2**63 - 1, "", "en", "", 2**63 - 1), row(-(2**63), "x" * 300_000),
    row(7, None, ""), row(7, None, ""), row(7, None, ""), row(8, "same id, other text", ""), row(8, "ß\n\t", ""),
    row(40, "no length", None, "s", None),
]


@pytest.mark.parametrize(("fan", "levels"), [(2, 12), (2, 1), (3, 2)])
def test_manifest(spark, fan, levels):
    rows = ROWS + ODD
    got = merkle.audit_manifest(spark.createDataFrame(rows, DOCS).repartition(3), fan, levels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, fan)


def test_one_row_and_none(spark):
    one = merkle.audit_manifest(spark.createDataFrame([row(5)], DOCS)).collect()
    assert [tuple(r) for r in one] == plain([row(5)], 2) and one[0].root == one[0].leaf
    assert one[0].proof_sha256 == digest()
    assert merkle.audit_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_states_are_those_of_sha256():
    words = np.random.default_rng(5).integers(0, 2**32, (70, 4, 8), dtype=np.uint32)
    kept, states = [], sha_states.fresh(70)
    for k in range(4):
        kept.append(sha_states.close(states, np.full(70, k)))
        states = sha_states.absorb(states, words[:, k])
    for k, closed in enumerate(kept):
        for i in range(70):
            text = "".join(sha_states.bytes_of(words[i, j : j + 1]).hex() for j in range(k))
            assert sha_states.bytes_of(closed[i : i + 1]).hex() == digest(text)


def test_folding_reads_no_left_sibling(spark):
    """Left siblings and the tops above them may be lost; the kept states stand for them."""
    leaves = merkle.document_leaves(spark.createDataFrame(ROWS, DOCS))
    manifest = merkle.build(leaves, 2, 12)
    chunk = next(r.asDict() for r in manifest.rounds[0].collect() if r.tree == "=en")
    opened = merkle.Chunk.opened(chunk, 2)
    at, top = 21, bytes(chunk["top"])
    new = sha_states.words_of(hashlib.sha256(b"new").digest())
    whole, blind = merkle.Folding(new), merkle.Folding(new)
    for step in opened.steps(np.array([at])):
        whole.up(step)
        kept = step.children.copy()
        kept[0, : step.slots[0] + 1] = 0
        blind.up(merkle.Step(step.slots, step.counts, step.states, kept))
    assert (whole.digests == blind.digests).all() and sha_states.bytes_of(whole.digests) != top


def test_places_a_manifest_lacks_fold_to_null(spark):
    manifest = merkle.build(merkle.document_leaves(spark.createDataFrame(ROWS, DOCS)))
    asked = spark.createDataFrame([("=xx", 0, bytes(32), 1)], "tree string, place long, digest binary, mark int")
    assert [tuple(r) for r in manifest.fold(asked).collect()] == [("=xx", 0, bytes(32), 1, None, None, None)]


def test_numbered(spark):
    rows = [("a", i % 5) for i in range(40)] + [("b", None), ("b", 3)] + [("c", 1)] * 30
    got = common.numbered(spark.createDataFrame(rows, "g string, v int").repartition(6), ["g"], ["v"])
    placed = sorted((r.g, r.place, r.v) for r in got.withColumn("v", F.coalesce("v", F.lit(-1))).collect())
    want = sorted((g, -1 if v is None else v) for g, v in rows)
    assert [(g, v) for g, _, v in placed] == want
    for name in "abc":
        own = [p for g, p, _ in placed if g == name]
        assert own == list(range(len(own)))
