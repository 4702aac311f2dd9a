"""Source divergence against a plain version, and transducers against sets of words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tallybook.llm import byte_runs, divergence, transducer

DOCS = "doc_id long, text string, lang string, source string, term string, ordinal string, n string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = shares(counts[lang, source])
        everything = sum((counts[g] for g in groups if g[0] == lang), Counter())
        q = shares(everything)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            r = shares(counts[lang, other])
            pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other.encode(), other))
        items = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(items)[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, **kwargs):
    found = divergence.audit_sources(spark.createDataFrame(rows, DOCS).repartition(4), **kwargs)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcÄ日", k=rng.randint(1, 4))) for _ in range(150)]
    out = []
    for i in range(120):
        own = rng.choices(vocabulary[: rng.choice([20, 150])], k=rng.randint(0, 40))
        text = rng.choice([" ", ", ", "-1-", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in own)
        out.append((i, text, rng.choice(["en", "en", "de"]), rng.choice(["s1", "s1", "s2", "ß", "s3"]), "x", "y", "z"))
    return out


ODD = [
    (1, None, None, None, "x", "y", "z"), (2, "", "fr", "a", "x", "y", "z"), (None, "1234 !", "fr", "b", "x", "y", "z"),
    (3, "one only here", "", "c", "x", "y", "z"), (4, "aa " * 5000 + "É" * 3000, "en", None, "x", "y", "z"),
    (5, "alone", "lone", "s", "x", "y", "z"), (6, "tie tie", "tt", "s", None, None, None), (6, "tie tie", "tt", "s", None, None, None),
    (6, "tie other", "tt", "s", None, None, None), (7, "other other", "tt", "r", "x", "y", "z"), (7, "Other", "tt", "q", "x", "y", "z"),
]


def test_audit(spark, rows):
    assert got(spark, rows + ODD) == plain(rows + ODD)
    assert got(spark, rows, min_docs=9, top=3) == plain(rows, 9, 3)


def test_pieces_blocks_and_passes_change_nothing(spark, rows, monkeypatch):
    """Long texts in pieces, small transducers, and several passes over the texts."""
    monkeypatch.setattr(byte_runs, "CHUNK", 64)
    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["text", "lang"])
    found = defaultdict(Counter)
    for part in divergence._term_documents([batch]):
        for lang, term, n in zip(*(part[c].to_pylist() for c in ("lang", "term", "docs")), strict=True):
            found[lang][term.decode()] += n
    want = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        want[lang].update(set(terms(text)))
    assert found == want

    docs = spark.createDataFrame(rows, DOCS)
    kept = divergence.kept_terms(docs)
    small = divergence.transducers(kept, block=16)
    assert small.count() > 6
    once = divergence.recounted(docs, divergence.transducers(kept))
    assert Counter(divergence.recounted(docs, small, pack=3).collect()) == Counter(once.collect())


def test_an_empty_table(spark):
    assert got(spark, []) == []


def test_shares_are_exact_for_large_counts(spark):
    import numpy as np
    from pyspark.sql import functions as F

    pairs = [(1, 1), (7 * 10**14, 9 * 10**14), (10**15, 3 * 10**15), (1, 9 * 10**15), (5, 7)]
    want = [1 + 10**9 * c // n for c, n in pairs]
    counts, totals = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert divergence._shares(counts, totals).tolist() == want
    frame = spark.createDataFrame(pairs, "c long, n long")
    assert [r[0] for r in frame.select(divergence.scaled_share(F.col("c"), F.col("n"))).collect()] == want


def test_transducer():
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcé日", k=rng.randint(0, 6))).encode() for _ in range(600)})
    machine = transducer.Transducer.from_bytes(transducer.minimal(words).to_bytes())
    asked = words + [w + b"x" for w in words] + [w[:-1] for w in words] + [b"\xff", b""]
    number = {w: i for i, w in enumerate(words)}
    assert machine.ordinals(pa.array(asked, pa.binary())).tolist() == [number.get(w, -1) for w in asked]
    assert [machine.word(i) for i in range(len(words))] == words
    futures = {frozenset(w[k:] for w in words if w[:k] == v[:k]) for v in words for k in range(len(v) + 1)}
    assert len(machine) == len(futures)
    assert transducer.minimal([]).ordinals(pa.array([b"", b"a"], pa.binary())).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        transducer.minimal([b"b", b"a"])
