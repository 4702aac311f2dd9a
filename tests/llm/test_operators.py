"""The training-data operators against plain versions, and their answers to awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallybook.llm import (
    common, decontaminate, hashing, licenses, lines, mixing, ngram_join, quality, queries, shards, substrings,
    url_rules, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, hub string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    """Prose with copies, near copies, shared passages, repeats, and texts of a few words."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = prose(60), prose(120)
    out = [" ".join(prose(rng.choice([3, 12, 40, 90, 200]))) for _ in range(30)]
    for _ in range(25):
        near = list(base)
        for spot in rng.sample(range(len(near)), rng.choice([0, 1, 1, 2, 3, 5])):
            near[spot] = rng.choice(vocabulary).upper()
        out.append("\n".join(" ".join(near[i : i + 30]) for i in range(0, 120, 30)))
    out += [" ".join(prose(20) + passage + prose(15)) for _ in range(4)]
    out += [out[0], out[31], " ".join(prose(10) + base[:45] + prose(3) + base[5:50])]
    return out


@pytest.fixture
def docs(spark):
    def make(values):
        rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z") if not isinstance(t, tuple) else t for i, t in enumerate(values)]
        return spark.createDataFrame(rows, DOCS)

    return make


def odd(texts):
    """Rows with null keys and texts, blank, long and repeated ones."""
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    whole = [(i, t, "en", "s", 1, "x", "y", "z") for i, t in enumerate(texts[:6])]
    return whole + [
        (100, None, None, None, None, None, None, None),
        (101, "", "en", "s", 0, "x", "y", "z"),
        (102, " \t\n ", "xx", "s", 0, "x", "y", "z"),
        (103, long, "en", "s", 0, "x", "y", "z"),
        (None, texts[0], "en", "s", 0, "x", "y", "z"),
        (None, None, None, "s", 0, "x", "y", "z"),
        whole[1], whole[1],
    ]


def shingled(text):
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def groups(pairs):
    """Component by key, plainly."""
    sets = {k: shingled(t) for k, t in pairs}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                same = len(sets[a] & sets[b])
                if sets[a] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same) and label[b] > label[a]:
                    label[b], changed = label[a], True
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_hashes_tell_words_apart():
    rows = ["ab ba", "BA\x0bab", None, "", "ü ü  u" + "x" * 50, " lone"]
    runs = list(hashing.hashed_words(pa.array(rows), lower=True))
    assert [c for _, n, _ in runs for c in n.tolist()] == [len(words(r)) for r in rows]
    h = np.concatenate([x for _, _, x in runs])
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 5


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = np.concatenate([h for _, _, h in hashing.hashed_words(pa.array([text, "x"]))])
    monkeypatch.setattr(hashing, "CHUNK", 1000)
    parts = np.concatenate([h for _, _, h in hashing.hashed_words(pa.array([text, "x"]))])
    assert (whole == parts).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (5, 5)] + [(i, i + 1) for i in range(100, 140)]
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in links:
        for a, b in links:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    lowest = {k: v for k, v in label.items()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in lowest.items() if k != v}


def test_similar_groups(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs(texts)).collect()}
    assert got == groups(list(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len(texts) - 10


def test_similar_groups_odd_rows(docs, texts):
    rows = odd(texts)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs(rows)).collect()), key=str)
    plain = groups([(r[0], r[1]) for r in rows if r[0] is not None])
    want = [(r[0], *plain[r[0]]) if r[0] is not None else (None, len(shingled(r[1])), None) for r in rows]
    assert got == sorted(want, key=str)


def test_matches_trade_length_for_count():
    free = np.zeros(200)
    assert ngram_join._choose(100, free, 75) == 1
    costly = np.concatenate([np.zeros(20), np.full(180, 1000.0)])
    assert ngram_join._choose(100, costly, 75) > 1


def test_keep_one(docs, texts):
    rows = odd(texts) + [(i + 200, t, "en", "s", 1, "x", "y", "z") for i, t in enumerate(texts)]
    kept = ngram_join.keep_one(docs(rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = Counter(r.doc_id for r in kept.collect())
    plain = groups([(r[0], r[1]) for r in rows if r[0] is not None])
    assert got == Counter([k for k, (_, c) in plain.items() if k == c] + [None, None])


def test_keep_one_judges_each_text_of_a_key(docs):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcd")
    row = lambda key, text: (key, text, "en", "s", 1, "x", "y", "z")
    rows = [row(1, a), row(5, f"{a} more"), row(5, b), row(7, f"{b} more"), row(8, c), row(8, f"{c} more"), row(8, d)]
    rows += [row(9, ""), row(9, None), row(9, None), row(9, d), row(10, d), row(None, d)]
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(docs(rows)).collect())
    want = [(1, a), (5, b), (8, c), (8, d), (9, ""), (9, None), (None, d)]
    assert got == Counter(want)


def test_quality_counts_and_verdicts(spark, docs, texts):
    repeated = "one two three four five six seven eight nine ten " * 4
    rows = odd(texts) + [(300, repeated, "en", "s", 1, "x", "y", "z"), (301, "a\n#a b|\na\n \n \n" + texts[4], "de", "s", 1, "x", "y", "z")]
    got = sorted(quality.quality_report(docs(rows)).drop("lang", "classes", "common").collect(), key=str)

    def plain(text):
        own = words(text)
        spots = defaultdict(list)
        for i in range(len(own) - 7):
            spots[tuple(own[i : i + 8])].append(i)
        inside = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(8)}
        listed = [s for s in (text or "").split("\n") if words(s)]
        return (
            len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(listed) - len(set(listed)), len(inside),
        )

    for r in got:
        texts_of = [t[1] for t in rows if t[0] == r.doc_id]
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert mine in [plain(t) for t in texts_of]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows)
    kept = quality.keep_good(docs(rows))
    assert kept.columns == docs(rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_quality_rejects_strange_histograms(docs):
    rng = random.Random(5)
    common_words = quality.COMMON_WORDS["en"]
    clean = [" ".join(rng.choice(common_words) if rng.random() < 0.5 else f"word{chr(97 + rng.randrange(26))}" for _ in range(200)) for _ in range(40)]
    strange = " ".join(rng.choice("ABCDEFG") * 3 + "!!" + str(i) for i in range(200))
    got = {r.doc_id: r.kept for r in quality.quality_report(docs([*clean, strange])).collect()}
    assert got == {i: i < 40 for i in range(41)}


def test_url_rules(spark):
    rules = [*queries.URL_RULES, url_rules.rule("block", "example.org"), url_rules.rule("allow", "a.example.org/x")]
    urls = [
        "http://example.com/en/1", "https://www.example.com/en/", "https://WWW.Example.com/en/x?q=/es/", "http://x.com",
        "http://x.com/", "http://com/en", "http://a.net/es/1", "http://a.net/es", "http://b.example.org", "xample.com/en/",
        "http://a.example.org/xyz", "http://a.example.org/y#/x", None, "", "a://b://c/d", "http://notexample.org/", "://net/fr/",
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    want = [(i, *plain(u)) for i, u in enumerate(urls)]
    for bound in (10, 0):
        got = url_rules.judge_urls(df, rules, max_broadcast=bound).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect())) == want
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


def test_license_bands_keep_their_promise():
    for n in (1, 3, 8, 20, 100):
        near = licenses.least_similarity(licenses.room(n), n)
        assert (1 - near) ** licenses.bands(near) <= licenses.MISS or near == 1


def test_licenses_odd_rows(docs, texts):
    gpl = licenses.TEMPLATES["gpl-3.0"]
    header = licenses.TEMPLATES["apache-2.0-header"]
    cut = header.rsplit(" ", 8)[0]
    rows = [*odd(texts), (400, f"{texts[2]} {gpl.upper()} {texts[3]}", "en", "s", 1, "x", "y", "z"),
            (401, f"{texts[3]}\n{cut}\n{texts[4]}", "en", "s", 1, "x", "y", "z"), (402, "All rights reserved", "en", "s", 1, "x", "y", "z")]
    found = licenses.scan_licenses(docs(rows)).collect()
    got = {(r.doc_id, r.license): round(r.containment, 3) for r in found}
    assert got[400, "gpl-3.0"] == got[402, "all-rights-reserved"] == got[401, "apache-2.0"] == 1.0
    assert 0.75 <= got[401, "apache-2.0-header"] < 1
    assert {k for k, _ in got} == {400, 401, 402} and len(found) == len(got)
    assert licenses.scan_licenses(docs([])).count() == 0 and licenses.scan_licenses(docs(rows), {}).count() == 0


def cut_repeats(rows, size):
    where = defaultdict(list)
    for r, text in enumerate(rows):
        own = words(text)
        for i in range(len(own) - size + 1):
            where[tuple(own[i : i + size])].append((r, i))
    gone = {(r, i + k) for spots in where.values() if len(spots) > 1 for r, i in spots for k in range(size)}
    return [[w for i, w in enumerate(words(t)) if (r, i) not in gone] for r, t in enumerate(rows)]


@pytest.mark.parametrize("size", [35, 12, 4])
def test_remove_repeats(docs, texts, size):
    rows = texts + [" ".join(["la"] * 50)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs(rows), words=size).collect()}
    want = {i: (len(words(t)), len(words(t)) - len(k), " ".join(k)) for i, (t, k) in enumerate(zip(rows, cut_repeats(rows, size), strict=True))}
    assert got == want


def test_windows_are_compared_by_all_bits():
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])
    one = np.ones(1, np.int64)

    def found(*hashes):
        held = [(one, one, 5 * one, k * one, np.array([h], np.uint64)) for k, h in enumerate(hashes)]
        return [r for b in substrings._repeated_runs(iter([substrings._run_blocks(held, schema)])) for r in b.to_pylist()]

    assert found(7 + (1 << 60), 7 + (2 << 60), 7) == []
    assert found(7 + (1 << 60), 7 + (1 << 60), 7) == [{"key": 0, "start": 5, "stop": 6}, {"key": 1, "start": 5, "stop": 6}]


def test_remove_repeats_odd_rows(docs, texts):
    rows = odd(texts)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs(rows)).collect()), key=str)
    kept = cut_repeats([r[1] for r in rows], 35)
    assert got == sorted(((r[0], len(words(r[1])), len(words(r[1])) - len(k), " ".join(k)) for r, k in zip(rows, kept, strict=True)), key=str)
    assert substrings.remove_repeats(docs([])).count() == 0
    assert substrings.levels(35) == [9, 18] and substrings.levels(5) == [5]


def test_lines(spark):
    pages = [(i, "h", ["menu", f"text {i}", "menu", "foot"] if i % 2 else ["menu", f"text {i}"]) for i in range(20)]
    pages += [(50, None, ["menu"]), (51, "", ["menu"]), (52, "h", None), (53, "k", ["menu", "only"]), (54, "h", []), (1, "h", ["menu"])]
    df = spark.createDataFrame(pages, "page_id long, host string, lines array<string>")
    rows = lines.drop_boilerplate(df, max_ratio=0.5).collect()
    got = sorted(((r.page_id, r.host, r.n_lines, r.n_dropped, r.kept_lines) for r in rows), key=str)
    want = [(p, h, len(x or []), (x or []).count("menu") if h == "h" else 0, [s for s in x or [] if s != "menu" or h != "h"]) for p, h, x in pages]
    assert got == sorted(want, key=str)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_html_lines(column):
    html = ["<p>a &amp; b<br>c<script>x<p></script> <b>d</b></p>\n<!-- e --><li> f </li>", None, "", "plain"]
    got = column(html, lambda c: F.array_join(lines.html_lines(c), "|"))
    assert got == ["a &amp; b|c|d|f", "", "", "plain"]


def plain_lines(html):
    text = re.sub(lines.HIDDEN, "\n", html or "")
    text = re.sub(lines.TAGS, "", re.sub(lines.BLOCKS, "\n", text))
    return [x for x in (part.strip(" \t") for part in re.split(r"[\n\r]+", text)) if x]


def test_both_ways_to_read_a_page(column, monkeypatch):
    rng = random.Random(17)
    signs = ["<script>", "</script>", "</SCRIPT >", "<Script a>", "<style>", "</style>", "<!--", "-->", "<p>", "</div", "<b", ">", "<", "a", " x ", "\n", "<scripts>", "--"]
    pages = ["".join(rng.choices(signs, k=rng.randint(0, 18))) for _ in range(3000)]
    want = ["|".join(plain_lines(page)) for page in pages]
    assert column(pages, lambda c: F.array_join(lines.html_lines(c), "|")) == want
    monkeypatch.setattr(lines, "LONG", 0)
    assert column(pages, lambda c: F.array_join(lines.html_lines(c), "|")) == want


def test_hostile_pages_are_read_in_time(column):
    import time

    pages = [unit * (1_000_000 // len(unit)) for unit in ("<", "<script>a ", "<!-- ", "<style>", "<p ", "</script><script>", "<!--<script>-->")]
    column(["<p>x"], lambda c: F.size(lines.html_lines(c)), "string")
    for page in pages:
        start = time.perf_counter()
        (got,) = column([page], lambda c: F.size(lines.html_lines(c)), "string")
        assert time.perf_counter() - start < 8, page[:20]
    assert column(["<" * 20_000 + "\ntext"], lambda c: F.array_join(lines.html_lines(c), "|"))[0].endswith("|text")


def shard_of(key, weights):
    seed = xxhash.xxh64_intdigest(str(key).encode(), seed=42)
    signed = seed - (1 << 64) if seed >> 63 else seed
    scores = []
    for s, w in enumerate(weights):
        first = xxhash.xxh64_intdigest(struct.pack("<q", signed), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), seed=first)
        scores.append((-np.log(((h >> 11) + 0.5) / 2**53) / w, s))
    return min(scores)[1]


def test_shards(docs, texts):
    rows = odd(texts) + [(1000 + i, "t", "en", "s", 1, "x", "y", "z") for i in range(300)]
    got = shards.shard_documents(docs(rows), [1.0] * 16, [1.0] * 17).collect()
    by_key = {r[0]: r[1] for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        if r.doc_id is not None:
            text = (by_key[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
            assert r.shard == shard_of(r.doc_id, [1.0] * 16)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shard_documents(docs([]), [1.0, 2.0]).count() == 0


def test_shard_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    light = shards.assign_shards(keys, [1.0, 3.0, 0.0])
    counts = {r["shard"]: r["count"] for r in light.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and abs(counts[1] / 20_000 - 0.75) < 0.02


def test_mixing_meets_targets_and_labels(spark):
    rng = random.Random(8)
    plain, bad = [f"w{i}" for i in range(50)], ["grim", "foul", "vile"]
    rows, labels = [], []
    for i in range(600):
        toxic, low = i % 5 == 0, i % 5 == 1
        own = [rng.choice(plain) + ("###" if low else "") for _ in range(rng.randint(30, 90))]
        if toxic:
            own[3] = rng.choice(bad)
        rows.append((i, " ".join(own)))
        if i < 300:
            labels.append((i, int(not low), int(toxic)))
    labels += [(None, 1, 0), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    got = {r.doc_id: r for r in mixing.mixing_rates(df, table, weights).collect()}
    truth = {i: "toxic" if i % 5 == 0 else "low" if i % 5 == 1 else "good" for i in range(600)}
    assert sum(got[i].domain == truth[i] for i in range(300, 600)) >= 285  # held out
    assert all(r.rate >= 0 for r in got.values())
    given = df.select("doc_id", F.col("text").alias("__t"))
    domains, scored = mixing._posteriors(given, df, table, weights, "doc_id", "text", mixing.LABEL)
    whole = scored.agg(F.sum("tokens")).first()[0]
    targets = [whole * weights[d] for d in domains]
    rate, reached = mixing.fit_rates(scored, targets)
    assert reached == pytest.approx(targets, rel=0.03)
    sums = scored.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * rate) for i in range(3)]).first()
    assert list(sums) == pytest.approx(reached)
    kept = {r.doc_id for r in mixing.mix_documents(df, table, {"good": 0.98, "low": 0.01, "toxic": 0.01}, "good").collect()}
    good = {i for i, r in got.items() if r.domain == "good"}
    assert good <= kept and len(kept - good) < 40


def fitted(tokens, p, targets, ceiling=np.inf, fixed=None, steps=mixing.STEPS, accelerate=True):
    """The rates by the same steps, plainly, and the weighted squares that are left."""
    held = (tokens[:, None] * p).sum(0)
    scale = 1 / np.sqrt(np.maximum(1, held))
    gram = (p * tokens[:, None]).T @ p * scale[:, None] * scale
    length, x, calm, turn = 1 / gram.sum(1).max(), np.ones(len(tokens)), 0, 1
    before, reached, last = x, held, held
    for _ in range(steps):
        ahead = (turn - 1) / (turn + 2) if accelerate else 0
        slopes = (1 + ahead) * reached - ahead * last - targets
        moved = np.clip(x + ahead * (x - before) - p @ (length * scale**2 * slopes), 0, ceiling)
        moved = moved if fixed is None else np.where(fixed, 1, moved)
        now = (tokens[:, None] * p * moved[:, None]).sum(0)
        turn = 1 if (scale**2 * slopes * (now - reached)).sum() > 0 else turn + 1
        calm = calm + 1 if np.abs(now - reached).max() <= mixing.TOLERANCE * held.sum() else 0
        before, x, last, reached = x, moved, reached, now
        if calm == 3 and accelerate:
            break
    return x, (scale**2 * (reached - targets) ** 2).sum()


def plain_posteriors(rows, labels, domains):
    """The classifier in plain Python: words and shapes of a text, counts by domain, and Bayes' rule."""
    parts = {key: [w for w in re.split(r"[^\w]+|_+", text.lower()) if w] for key, text in rows}
    cut = lambda share, name, *edges: f"{name}:{sum(share > e for e in edges)}"
    features = {}
    for key, text in rows:
        size, own = max(1, len(parts[key])), list(dict.fromkeys(parts[key]))
        shapes = [
            cut(len(re.findall(r"[#*$%&|<>!]", text)) / size, "symbols", 0.05, 0.3, 1.0),
            cut(len(re.findall("[A-Z]{2}", text)) / size, "capitals", 0.1, 0.5),
            cut(1 - len(own) / size, "repeats", 0.3, 0.6, 0.9), "short:1" if size < 20 else "short:0",
        ]
        features[key] = own + shapes
    taught = {}
    for key, quality, toxic in labels:
        domain = "toxic" if toxic == 1 else "low" if quality == 0 else "good" if quality == 1 or toxic == 0 else None
        if key is not None and domain:
            taught[key] = min(domain, taught.get(key, domain))
    taught = {k: d for k, d in taught.items() if k in features}
    n = Counter(taught.values())
    seen = defaultdict(Counter)
    for key, domain in taught.items():
        seen[domain].update(features[key])
    everything = len(taught)
    vocabulary = []
    for word in {w for c in seen.values() for w in c}:
        present = sum(seen[d][word] for d in domains)
        information = 0.0
        for d in domains:
            for a, row in ((seen[d][word], present), (n[d] - seen[d][word], everything - present)):
                information += a * np.log(a * everything / (row * max(n[d], 1))) if a and row else 0.0
        often = [seen[d][word] >= max(1, mixing.MIN_SHARE * n[d]) for d in domains]
        telling = any(o and seen[d][word] * everything >= mixing.MIN_LIFT * n[d] * present for o, d in zip(often, domains, strict=True))
        if present >= mixing.MIN_DOCUMENTS and (telling and information >= mixing.MIN_INFORMATION or ":" in word and any(often)):
            vocabulary.append(word)
    out = {}
    for key, own in features.items():
        scores = []
        for d in domains:
            score = np.log((n[d] + 1e-6) / (everything + 1))
            for word in vocabulary:
                share = (seen[d][word] + 0.5) / (n[d] + 1)
                if word in own:
                    score += np.log(share)
                elif ":" not in word:
                    score += np.log1p(-share)
            scores.append(score)
        raised = np.exp(np.array(scores) - max(scores))
        out[key] = len(parts[key]), raised / raised.sum()
    return out


def test_mixing_against_plain_python(spark):
    rng = random.Random(21)
    words_ = {"good": [f"w{i}" for i in range(60)], "low": [f"j{i}" for i in range(20)], "toxic": ["grim", "foul", "vile"]}
    rows, labels = [], []
    for i in range(400):
        domain = "toxic" if i % 9 == 0 else "low" if i % 4 == 0 else "good"
        own = rng.choices(words_["good"], k=rng.randint(10, 60)) + rng.choices(words_[domain], k=rng.randint(1, 12))
        rng.shuffle(own)
        text = " ".join(w.upper() if rng.random() < 0.05 else w for w in own) + rng.choice(["", " ### !", " $$"])
        rows.append((i, text))
        if i % 5:
            labels.append((i, int(domain != "low"), int(domain == "toxic")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = {"good": 0.75, "low": 0.25, "toxic": 0.0}
    domains, scored = mixing._posteriors(df.select("doc_id", F.col("text").alias("__t")), df, table, weights, "doc_id", "text", mixing.LABEL)
    want = plain_posteriors(rows, labels, domains)
    got = {r.doc_id: r for r in scored.collect()}
    for key, (size, p) in want.items():
        assert got[key].tokens == size and got[key].p == pytest.approx(p, abs=1e-9)

    tokens, p = np.array([want[i][0] for i, _ in rows], float), np.array([want[i][1] for i, _ in rows])
    shares = np.array([weights[d] for d in domains])
    rates, left = fitted(tokens, p, tokens.sum() * shares)
    found = {r.doc_id: r for r in mixing.mixing_rates(df, table, weights).collect()}
    assert [found[i].rate for i, _ in rows] == pytest.approx(rates.tolist(), abs=1e-6)
    # No worse than ten times as many plain steps, and than all rates at 1 by far.
    assert left <= 1.05 * fitted(tokens, p, tokens.sum() * shares, steps=10 * mixing.STEPS, accelerate=False)[1]
    assert left < 0.05 * fitted(tokens, p, tokens.sum() * shares, steps=0)[1]

    own, fixed = p[:, domains.index("good")], p[:, domains.index("good")] == p.max(1)
    size = (tokens * own).sum() / weights["good"]
    rates, _ = fitted(tokens, p, size * shares, 1.0, fixed)
    kept = {r.doc_id for r in mixing.mix_documents(df, table, weights, "good").collect()}
    drawn = {r.doc_id: r.u for r in scored.select("doc_id", mixing.uniform("doc_id", "tokens").alias("u")).collect()}
    close = {i for i, _ in rows if abs(drawn[i] - rates[i]) < 1e-6}
    assert kept - close == {i for i, _ in rows if drawn[i] < rates[i]} - close and len(close) < 3


def test_mixing_learns_the_words_of_a_rare_domain(spark):
    # 1% toxic with three of ten words each, 10% low with twenty of ninety; 20,000 labelled and 1,000 not.
    draw = lambda name, of, n: f"transform(sequence(1, {n}), j -> concat('{name}', pmod(xxhash64('{name}', id, j), {of})))"
    df = spark.range(21_000).selectExpr(
        "id as doc_id", "case when id % 100 = 0 then 'toxic' when id % 10 = 1 then 'low' else 'good' end as truth",
        f"""array_join(concat({draw("w", 300, 30)}, case when id % 100 = 0 then {draw("grim", 10, 3)}
            when id % 10 = 1 then {draw("junk", 90, 20)} else {draw("w", 300, 5)} end), ' ') as text""",
    )
    labels = df.where("doc_id < 20000").selectExpr("doc_id", "int(truth != 'low') as quality", "int(truth = 'toxic') as toxic")
    classifier = mixing.fit_classifier(df, labels, ["good", "low", "toxic"])
    assert {f"grim{i}" for i in range(10)} | {f"junk{i}" for i in range(90)} <= set(classifier.vocabulary)
    assert not [w for w in classifier.vocabulary if w.startswith("w")]
    kept = mixing.mix_documents(df, labels, queries.DOMAIN_WEIGHTS, "good").groupBy("truth").count().collect()
    kept = {r["truth"]: r["count"] for r in kept}
    assert kept["good"] == 21_000 - 210 - 2100 and kept.get("toxic", 0) <= 10


def test_mixing_odd_rows(spark, docs, texts):
    table = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = odd(texts)
    got = mixing.mixing_rates(docs(rows), table, queries.DOMAIN_WEIGHTS).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(r.rate >= 0 for r in got)
    assert mixing.mixing_rates(docs([]), table, queries.DOMAIN_WEIGHTS).count() == 0
    kept = mixing.mix_documents(docs(rows), table, queries.DOMAIN_WEIGHTS, "good")
    assert kept.columns == docs(rows).columns and kept.count() <= len(rows)


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(30),) for _ in range(rng.randrange(9))) for _ in range(k)]
        got = [runs[r][p] for r, p in warc.merge_order(runs)]
        assert got == sorted(x for r in runs for x in r)
    assert list(warc.merge_order([])) == []


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    pages = [(i, f"http://h{i % 3}.example.com/{i % 4}", ["same", f"page {i}", tricky, "ü" * 500, "", None][i % 6]) for i in range(60)]
    pages += [(None, "http://a.b/", "same"), (7, None, "page 7"), (200, "a b\nc", "y" * 20_000)]
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    rows = warc.archive_index(df, str(tmp_path / "w"))
    got = rows.collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for key, _, html in pages:
        if key is not None:
            first[digest(html)] = min(first.get(digest(html), key), key)
    want = Counter()
    for key, _, html in pages:
        refers = first.get(digest(html)) if key is not None and first[digest(html)] != key else None
        want[key, len((html or "").encode()), digest(html), "revisit" if refers is not None else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.intact for r in got) and len({r.file for r in got}) > 3
    merged = warc.merge_runs(spark.read.parquet(str(tmp_path / "w" / "runs")), ranges=4).collect()
    order = [(r.url_key, r.date, r.page_id is not None, r.page_id or 0) for r in sorted(merged, key=lambda r: (r.part, r.position))]
    assert order == sorted(order) and len(order) == len(pages) and len({r.part for r in merged}) > 1
    assert warc.archive_index(df.limit(0), str(tmp_path / "none")).count() == 0


def test_archives_of_large_keys(spark, tmp_path):
    keys = [300_000_000_000, 9 * 10**18, -(2**63), 2**63 - 1, -5, 0, 2, 3, None]
    rows = [(k, "http://one.example.com/", f"page {k}") for k in keys]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(warc.archive_index(df, str(tmp_path / "w")).collect(), key=lambda r: (r.part, r.position))
    assert Counter(r.page_id for r in got) == Counter(keys) and all(r.intact for r in got)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.date) for r in got)
    assert [(r.date, r.page_id is not None, r.page_id or 0) for r in got] == sorted((r.date, r.page_id is not None, r.page_id or 0) for r in got)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert all(r.payload_digest == digest(f"page {r.page_id}") for r in got)
    moments = [("0001-01-01 00:00:00",), ("9999-12-31 23:59:59",), ("2024-05-06 07:08:09",), (None,)]
    dated = spark.createDataFrame([(i, "http://a.b/", str(i), *m) for i, m in enumerate(moments)], "page_id long, url string, html string, at string")
    far = F.col("at").cast("timestamp") + F.expr("interval 20000 years") * (F.col("page_id") == 1).cast("int")
    warc.write_archives(dated.withColumn("at", far), str(tmp_path / "d"), date="at")
    dates = {r.page_id: r.date for r in warc.read_records(spark, str(tmp_path / "d")).collect()}
    assert dates == {0: "0001-01-01T00:00:00Z", 1: "9999-12-31T23:59:59Z", 2: "2024-05-06T07:08:09Z", 3: warc.EPOCH}


def test_find_items(spark, docs, texts):
    rng = random.Random(9)
    items = [(i, " ".join(f"q{rng.randrange(300)}" for _ in range(rng.randint(14, 50)))) for i in range(12)]
    items += [(20, None), (21, " "), (22, "so short"), (None, "x y z a b c"), (23, items[3][1])]
    hidden = []
    for j in range(12):
        own = items[j][1].split()
        if j % 3 == 1:
            own[-1] += "!"
        if j % 3 == 2:
            own[len(own) // 2] = "other"
        hidden.append(f"{texts[j]} {' '.join(own).upper()} {texts[j + 1]}")
    rows = odd(texts) + [(500 + j, t, "en", "s", 1, "x", "y", "z") for j, t in enumerate(hidden)] + [(600, "So SHORT", "en", "s", 1, "x", "y", "z")]
    table = spark.createDataFrame(items, "item_id long, text string")

    def grams(own):
        return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))

    known = {i: words(t.lower()) for i, t in items if i is not None and words(t)}
    seen = Counter(g for own in known.values() for g in grams(own))
    weigh = lambda g: 1 + int(np.log2(len(known) / seen[g])) if g in seen else 1 + int(np.log2(len(known)))
    want = {}
    for key, text, *_ in rows:
        own = words((text or "").lower())
        for item, theirs in known.items():
            size = min(len(theirs), len(own))
            best = None
            for s in range(len(own) - size + 1) if own else ():
                a, b = grams(own[s : s + size]), grams(theirs)
                if not a & b:
                    continue
                common_weight = sum(weigh(g) * min(a[g], b[g]) for g in a | b)
                united = sum(weigh(g) * max(a[g], b[g]) for g in a | b)
                if 100 * common_weight >= 75 * united and (best is None or common_weight / united > best[1]):
                    best = s, common_weight / united
            if best:
                want[key, item] = (best[0], round(best[1], 9))
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in decontaminate.find_items(docs(rows), table).collect()}
    assert got == want and (600, 22) in got and sum(k[0] == 501 for k in got)
    clean = decontaminate.drop_contaminated(docs(rows), table)
    assert clean.columns == docs(rows).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in {k for k, _ in want})
    assert decontaminate.find_items(docs(rows), table.limit(0)).count() == 0
    assert decontaminate.find_items(docs([]), table).count() == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    index = decontaminate.ItemIndex(list(range(40)), [" ".join(f"t{i}x{j}" for j in range(20)) for i in range(40)])
    prints = index.prints[index.sizes[20][0]]
    probes = []
    for p in prints:
        for n in (0, 5, 23, 46, 47, 48):
            bits = np.unpackbits(p)
            bits[rng.choice(decontaminate.BITS, n, replace=False)] ^= 1
            probes.append(np.packbits(bits))
        # The worst spread: as many bits in every byte as can be, and one more.
        bits = np.unpackbits(p).reshape(-1, 8)
        bits[:, :3] ^= 1
        bits[0, 0] ^= 1
        probes.append(np.packbits(bits))
    probes = np.array(probes, np.uint8)
    window, item = index.within(20, probes)
    near = decontaminate.distances(np.repeat(probes, 40, axis=0), np.tile(prints, (len(probes), 1))) <= decontaminate.RADIUS
    found = {(int(w), int(i)) for w, i in zip(window, item, strict=True)}
    assert found == {(k // 40, k % 40) for k in np.flatnonzero(near).tolist()}
    assert {(7 * i + 6, i) for i in range(40)} <= found and decontaminate.RADIUS == 47


def test_fingerprints_in_stretches_are_those_of_each_window(monkeypatch):
    rng = np.random.default_rng(6)
    found, weights = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(1, 9, 900)
    starts = np.flatnonzero(rng.random(880) < 0.3)
    whole = decontaminate.fingerprints(found, weights, 20, starts)
    monkeypatch.setattr(decontaminate, "STRETCH", 50)
    assert (decontaminate.fingerprints(found, weights, 20, starts) == whole).all()
    one = [decontaminate.fingerprints(found[s : s + 20], weights[s : s + 20], 20, np.zeros(1, np.int64))[0] for s in starts]
    assert (np.array(one) == whole).all()


def test_blocks_of_items_give_equal_rows(spark, docs, monkeypatch):
    rng = random.Random(13)
    shared = [f"s{i}" for i in range(14)]
    items = [(i, " ".join([f"q{i}x{j}" for j in range(20)] + shared[: rng.choice([0, 8, 14])])) for i in range(24)]
    items += [(50, items[3][1]), (51, ""), (52, None)]
    rows = []
    for i, text in items[:24]:
        for n in range(1, 5):
            own = text.split()
            own[-n:] = [f"{w}!" for w in own[-n:]]
            rows.append(f"before {' '.join(own)} after")
            own = text.split()
            own[:n] = shared[:n]
            rows.append(" ".join([*own, *shared]))
    given = docs([*rows, None, "", "clean text", None])
    table = spark.createDataFrame(items, "item_id long, text string")
    plain = sorted(decontaminate.find_items(given, table).collect())
    clean = sorted(r.doc_id for r in decontaminate.drop_contaminated(given, table).collect())
    assert 0 < len({r.doc_id for r in plain}) < len(rows) and len(clean) + len({r.doc_id for r in plain}) == len(rows) + 4
    monkeypatch.setattr(decontaminate, "MAX_BLOCK_WORDS", 60)
    assert sorted(decontaminate.find_items(given, table).collect()) == plain
    kept = decontaminate.drop_contaminated(given, table)
    assert kept.columns == given.columns and sorted(r.doc_id for r in kept.collect()) == clean


def exact_matches(index, hashed, counts):
    """Matches by the exact sums of every window, without fingerprints: what the fingerprints are measured against."""
    out = []
    for doc, (n, end) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)):
        for item, size in enumerate(index.lengths.tolist()):
            width, length = min(size, index.words), min(size, n)
            own = hashing.windows(hashed[end - n : end], np.array([n]), width)[0]
            if len(own):
                span = length - width + 1
                best = index._best(own, index.weigh(own), span, item, np.arange(len(own) - span + 1))
                out += [(doc, index.ids[item], *best)] if best else []
    return out


@pytest.mark.parametrize("common", [0, 12])
def test_edited_items_are_found(common):
    """Of 2,400 windows at or just above the threshold none is further from its item than the radius.

    Words are replaced at the end, on both sides or anywhere, or the document is cut off; with ``common`` words that
    many items share, shingles weigh differently.
    """
    rng = random.Random(12)
    fresh = lambda: f"z{rng.randrange(10**9)}"
    shared = [[fresh() for _ in range(common)] for _ in range(3)]
    items = [[fresh() for _ in range(size - common)] for size in (16, 20, 34, 59) for _ in range(150)]
    items = [own[: len(own) // 2] + shared[k % 3] + own[len(own) // 2 :] for k, own in enumerate(items)]
    index = decontaminate.ItemIndex(list(range(len(items))), [" ".join(own) for own in items])
    texts, want = [], set()
    for k, own in enumerate(items):
        for way in range(4):
            edited = None
            for x in range(1, len(own) // 2):
                tried = list(own)
                if way == 0:
                    tried[-x:] = [fresh() for _ in range(x)]
                elif way == 1:
                    tried = tried[:-x]
                elif way == 2:
                    tried[: x // 2] = [fresh() for _ in range(x // 2)]
                    tried[-(x - x // 2) :] = [fresh() for _ in range(x - x // 2)]
                else:
                    for spot in rng.sample(range(len(own)), x):
                        tried[spot] = fresh()
                (run,) = hashing.hashed_words(pa.array([" ".join(tried)]), lower=True)
                grams = index.shingles(run[2])
                span = min(len(tried), len(own)) - 4
                if index._best(grams, index.weigh(grams), span, k, np.arange(len(grams) - span + 1)) is None:
                    break
                edited = tried
            if edited:
                want.add((len(texts), k))
                texts.append(" ".join(edited))
    got = set()
    for row, counts, hashed in hashing.hashed_words(pa.array(texts), lower=True):
        for doc, matches in index.documents(hashed, counts):
            got |= {(row + doc, m[0]) for m in matches}
    assert len(want) > 1700 and want <= got


def test_fingerprints_find_what_exact_sums_find(data):
    """Every match of the given tables, by all windows of every document against every item."""
    import pyarrow.parquet as pq

    items, documents = (pq.read_table(f"{data}/{name}.parquet") for name in ("benchmark", "documents"))
    index = decontaminate.ItemIndex(items["item_id"].to_pylist(), items["text"].to_pylist())
    for _, counts, hashed in hashing.hashed_words(documents["text"].combine_chunks(), lower=True):
        got = [(doc, *m) for doc, found in index.documents(hashed, counts) for m in found]
        assert got == sorted(exact_matches(index, hashed, counts)) and got


def test_native_plans_have_no_python(spark, data, capsys):
    for name in ("op2_quality_rules", "op4_license_scans", "op8_source_mixing"):
        queries.QUERIES[name](spark, data).explain()
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
