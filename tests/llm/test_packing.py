"""Packing against brute force, and token ids against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallybook.llm import packing, set_queries

DOCS = "doc_id long, text string, lang string, ids string, length string, place string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def fewest(items, capacity):
    """The least number of sequences, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, bins):
        if len(bins) < best[0] and i == len(items):
            best[0] = len(bins)
        if len(bins) >= best[0] or i == len(items):
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            put(i + 1, bins)
            bins[k] -= items[i]
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


def placed(counts, capacity):
    """Sequences of a plan as lists of lengths; places are gapless and within the capacity."""
    found = packing.plan(counts, capacity)
    length = np.array([w for w, n in counts.items() for _ in range(n)], np.int64)
    place = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = found.locate(length, place)
    bins = defaultdict(list)
    for s, o, w in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)):
        assert o == sum(bins[s])
        bins[s].append(w)
    assert max(map(sum, bins.values())) <= capacity and sorted(bins) == list(range(found.sequences))
    return bins


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(4)
    reduced = 0
    for _ in range(400):
        capacity = rng.choice([10, 17, 30])
        least = rng.choice([1, 1, 3, 6])
        items = [rng.randint(least, capacity) for _ in range(rng.randint(1, 9))]
        instance = packing.Instance(Counter(items), capacity)
        instance.reduce()
        rest = [w for w, n in enumerate(instance.counts.tolist()) for _ in range(n)]
        assert sum(n for _, n in instance.packed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
        reduced += len(items) - len(rest)
        assert len(placed(Counter(items), capacity)) <= fewest(items, capacity) + 1
    assert reduced > 1000


def test_large_instances_come_near_the_bound():
    rng = np.random.default_rng(2)
    for lengths in (np.clip(rng.lognormal(6, 1, 30_000).astype(int) + 1, 1, 4096), rng.integers(1, 4097, 20_000)):
        counts = Counter(lengths.tolist())
        assert len(placed(counts, 4096)) <= 1.01 * -(-int(lengths.sum()) // 4096) + 1


def test_words_have_the_ids_of_their_text(tokenizer, monkeypatch):
    texts = [
        "The cat's whiskers, they'll   say\tso!", "", None, " \n ", "x" * 5000 + " y", "naïve é   a b ÅΣΑΣ",
        "1234 a1b2 <|endoftext|> it's'n", "日本 語 🙂🙂 \x00 \x1f", "don't 'tis rock'n'roll ... --- I'M",
    ]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for chunk in (1 << 22, 40):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        run = packing._tokenised(None, 50, 1)
        batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        got = defaultdict(list)
        for out in run([batch]):
            for row in out.to_pylist():
                ids = np.frombuffer(row["ids"], "<u4").tolist()
                assert row["piece"] * 50 == row["start"] == len(got[row["doc_id"]]) and len(ids) == row["length"] <= 50
                got[row["doc_id"]] += ids
        assert [got[k] for k in range(len(texts))] == [w + [1] for w in want]


def test_a_full_memory_of_words_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_PARTS", 5)
    known = packing.PartIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("a b c", "a d e f", "g h i j k l m", "a b g"):
        ids, _ = known.encoded(pa.array([w.encode() for w in text.split()], pa.binary()))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_of_words_have_the_ids_of_the_text(tokenizer):
    rng = random.Random(12)
    signs = ["a", "Zb", "'", "s", "t", "re", "LL", "1", "23", ".", "--", "...", "<", "|", ">", "é", "e\u0301", "=\u0338", "İ", "ß", "日", "🙂", "_", "x1", " ", "\n", "\u00a0", "<|endoftext|>", "K"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += ["O'Neill's <|ENDOFTEXT|> a<|endoftext|>b", "A.B-c_D,e1f22", "l'été.", "''s", "--'s", "x'sun"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = {}
    for out in packing._tokenised(None, 4096, 1)([batch]):
        got.update({r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out.to_pylist()})
    for i, text in enumerate(texts):
        assert got[i] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_pack_documents(spark, tokenizer):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["one", "two", "unbelievable", "x"], k=rng.randint(1, 70))) for _ in range(60)]
    rows = [(i, t, "en", "a", "b", "c") for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None), (70, None, *"abcd"), (71, "", *"abcd"), rows[3], rows[3]]
    packed = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(5), capacity=64)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = packed.collect()
    want = Counter()
    for key, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            want[key, piece, start, np.array(ids[start : start + 64], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sum(x.length for x in bins[r.sequence_id])
        bins[r.sequence_id].append(r)
    assert all(sum(x.length for x in b) <= 64 for b in bins.values())
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.packed_pieces(spark.createDataFrame(got, packed.schema), 64)).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in got) and max(map(len, whole.values())) <= 256
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_query(spark, data, tokenizer):
    got = set_queries.op11_best_fit_packing(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for key, rows in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.start for r in rows] == list(range(0, len(ids), 4096)) and sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
    total = sum(r.length for r in got)
    assert all(sum(r.length for r in rows) <= 4096 for rows in by_sequence.values())
    assert len(by_sequence) <= -(-total // 4096) + 2
