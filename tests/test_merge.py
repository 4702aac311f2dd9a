"""Two-source comparison, confidence merge, and routing on small fixtures."""

import itertools
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallybook.functions.pycompat import py_float_text
from tallybook.functions.similarity import similarity_bound
from tallybook.operators import layout_extract as L
from tallybook.operators import reconcile as M
from tallybook.operators import routing
from tallybook.sources import derived as D

AT = "2024-12-31T00:00:00"
ITEM = ("Widget", 1.0, 2.0, 2.0)


def merged(left, right):
    return {r.invoice_id: r for r in M.merge_sources(left, right, AT).collect()}


def test_presence_and_values(invoices):
    left = invoices(
        {"invoice_number": "A-1", "vendor_name": " ", "total_amount": 0.0, "line_items": [ITEM, ITEM]},
        {"invoice_number": "A-2", "vendor_name": "Acme Corp", "total_amount": 100.0, "line_items": []},
    )
    right = invoices(
        {"invoice_number": None, "vendor_name": "V", "total_amount": 5.0, "line_items": [ITEM]},
        {"invoice_number": "a-2", "vendor_name": "Acme Corporation", "total_amount": 105.0, "line_items": [ITEM]},
    )
    rows = merged(left, right)
    by_field = {i: {c.field_name: c for c in r.field_comparisons} for i, r in rows.items()}
    assert by_field[0]["invoice_number"].selection_reason == "Google unavailable, using PDF"
    assert by_field[0]["vendor_name"].selected_value == "V" and by_field[0]["vendor_name"].confidence_score == 90.0
    assert by_field[0]["total_amount"].is_mismatch  # from zero to anything is 100 percent
    assert by_field[0]["line_items"].confidence_score == 75.0 and by_field[0]["line_items"].is_mismatch
    assert by_field[0]["due_date"].selection_reason == "Both sources missing"
    assert not by_field[1]["invoice_number"].is_mismatch
    assert by_field[1]["vendor_name"].selection_reason == "Different values (similarity=72.0%), using Google"
    assert not by_field[1]["total_amount"].is_mismatch  # exactly five percent is not beyond it
    assert by_field[1]["line_items"].selection_reason == "PDF unavailable, using Google"
    assert rows[0].line_items == [ITEM] and rows[0].mismatch_count == 2
    assert [c.field_name for c in rows[0].field_comparisons] == [f.name for f in M.FIELDS]
    assert rows[1].quality_score == 70.0 and rows[1].recommendation == "review"


def test_missing_side_and_null_keys(spark, invoices):
    left = invoices({"invoice_id": 1, "vendor_name": "L"}, {"invoice_id": None, "vendor_name": "N1"})
    right = invoices({"invoice_id": 2, "vendor_name": "R"}, {"invoice_id": None, "vendor_name": "N2"})
    rows = M.merge_sources(left, right, AT).collect()
    assert sorted(r.vendor_name for r in rows) == ["L", "N1", "N2", "R"]
    assert sum(r.pdf_source is None for r in rows) == 2


def test_text_comparison_against_difflib(spark, invoices):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    left = invoices(*[{"vendor_name": n} for n in names])
    right = invoices(*[{"vendor_name": n} for n in names[::-1]])
    rows = merged(left, right)
    for i, (a, b) in enumerate(zip(names, names[::-1])):
        c = next(c for c in rows[i].field_comparisons if c.field_name == "vendor_name")
        if a.strip() and b.strip():
            ratio = SequenceMatcher(None, a.lower(), b.lower()).ratio()
            assert c.is_mismatch == (ratio <= 0.85)
            assert f"(similarity={ratio * 100:.1f}%)" in c.selection_reason
            assert c.selected_value == b


def test_amount_reasons(invoices):
    amounts = [(100.0, 110.0), (2000.0, 2001.0), (3.0, 1.0), (-5.0, 5.0), (0.0, 0.0), (1e8, 2e8)]
    rows = merged(
        invoices(*[{"subtotal": a} for a, _ in amounts]), invoices(*[{"subtotal": b} for _, b in amounts])
    )
    for i, (a, b) in enumerate(amounts):
        difference = abs(b - a) / abs(a) * 100 if a else 0
        c = next(c for c in rows[i].field_comparisons if c.field_name == "subtotal")
        assert c.selection_reason == f"Google preferred (Google={b}, PDF={a}, diff={difference:.1f}%)"
        assert c.is_mismatch == (difference > 5)


def test_merge_never_loses_a_value(spark, data):
    first = D.invoices(spark, data)
    second = D.second_source(first)
    both = M.merge_sources(first, second, AT).alias("m").join(
        first.select("invoice_id", F.col("buyer_name").alias("l")), "invoice_id"
    )
    assert both.filter(F.col("l").isNotNull() & F.col("buyer_name").isNull()).count() == 0


def test_long_and_wide_merge(spark):
    rows = [
        (1, "invoice_number", "R", 60.0, "regex"),
        (1, "invoice_number", "L", 60.0, "layout"),
        (2, "invoice_number", "R", 60.0, "regex"),
        (2, "invoice_number", "L", 61.0, "layout"),
        (3, "total_amount", "5", 90.0, "layout"),
        (3, "total_amount", None, 95.0, "model"),
        (4, "total_amount", "5", 90.0, "layout"),
        (4, "total_amount", "6", 95.0, "model"),
    ]
    df = spark.createDataFrame(rows, "invoice_id bigint, field string, value string, confidence double, source string")
    long = L.merge_by_confidence(df)
    assert {r.invoice_id: (r.value, r.source) for r in long.collect()} == {
        1: ("R", "regex"),
        2: ("L", "layout"),
        3: ("5", "layout"),
        4: ("6", "model"),
    }
    wide = {r.invoice_id: r for r in L.to_wide(long).collect()}
    assert wide[4].total_amount == 6.0 and wide[4].confidence.total_amount == 95.0


def test_layout_fallbacks(spark):
    texts = [
        (1, "Invoice 7\nJane Doe 5 Main Street\nTotal: 100\nTax: 20"),
        (2, "Bill\nabc\nGood Vendor\nTotal: 100\nTax: 0\nSubtotal: 90"),
        (3, "Total: 100\nZwischensumme: 10"),
    ]
    df = spark.createDataFrame(texts, "invoice_id bigint, text string")
    rows = {r.invoice_id: r for r in L.extract_layout(df).collect()}
    assert rows[1].buyer_name == "Jane Doe" and rows[1].source["buyer_name"] == "heuristic"
    assert rows[1].subtotal == 80.0 and rows[1].confidence["subtotal"] == 80.0
    assert rows[2].vendor_name == "Good Vendor" and rows[2].tax_amount == 10.0
    assert rows[3].tax_amount is None and rows[3].subtotal == 10.0
    assert rows[3].vendor_name == "Total: 100" and rows[3].confidence["vendor_name"] == 50.0


def test_words_beyond_the_first_ten_do_not_count(spark):
    words = [(1, i, 0, "ab", 10.0) for i in range(10)] + [(1, 10, 0, "Vendor", 10.0)]
    words += [(2, 5, 0, "Second", 10.0), (2, 1, 0, "Invoice", 10.0), (2, 2, 0, "First", 149.9), (2, 0, 1, "Page", 1.0)]
    words += [(3, 1, 0, "TooLow", 150.0)]
    df = spark.createDataFrame(words, "invoice_id bigint, ord int, page int, text string, y0 double")
    assert {r.invoice_id: r.vendor_word for r in L.vendor_from_words(df).collect()} == {2: "First"}


def expected_pick(requested, states):
    """States: ok, failed or None (not tried) of document, model and local extraction."""
    document, model, local = states
    if requested == "auto":
        if document == "ok":
            return "Google Document AI", 95.0
        if document == "failed":
            if model == "ok":
                return "Gemini Extraction (Fallback)", 85.0
            if model is None:
                return "PDF Extractor (Fallback)", 60.0
            return "PDF Extractor (Emergency Fallback)", 0.0
        if model is not None:
            return ("Gemini Extraction", 90.0) if model == "ok" else ("PDF Extractor (Emergency Fallback)", 0.0)
        return "PDF Extractor (Regex)", 70.0
    if requested == routing.DOCUMENT:
        return ("Google Document AI", 95.0) if document == "ok" else ("PDF Extractor (Emergency Fallback)", 0.0)
    if requested == routing.MODEL:
        return ("Gemini Extraction", 90.0) if model == "ok" else ("PDF Extractor (Emergency Fallback)", 0.0)
    if requested == routing.LOCAL:
        return "PDF Extractor (Regex)", 70.0
    return "PDF Extractor (Default)", 0.0


def test_pick_extraction(spark):
    cases = list(itertools.product(["ok", "failed", None], ["ok", "failed", None], ["ok"]))
    methods = [routing.DOCUMENT, routing.MODEL, routing.LOCAL]
    rows = [
        (i, m, s == "ok", f"{i}-{m}") for i, case in enumerate(cases) for m, s in zip(methods, case) if s is not None
    ]
    df = spark.createDataFrame(rows, "invoice_id int, method string, ok boolean, payload string")
    for requested in ["auto", *methods, "other"]:
        got = {r.invoice_id: r for r in routing.pick_extraction(df, requested).collect()}
        assert {i: (r.model_used, r.confidence) for i, r in got.items()} == {
            i: expected_pick(requested, case) for i, case in enumerate(cases)
        }
        assert all(r.payload == f"{i}-{r.method}" for i, r in got.items())
        assert all((r.error is not None) == r.model_used.endswith("(Emergency Fallback)") for r in got.values())


def test_items_as_json_text(invoices):
    row = merged(invoices({"line_items": [ITEM, ITEM]}), invoices({"line_items": [ITEM]}))[0]
    shown = next(c for c in row.field_comparisons if c.field_name == "line_items")
    assert shown.google_value == '[{"description":"Widget","quantity":1.0,"price":2.0,"total":2.0}]'
    assert row.mismatches[0].startswith("line_items: PDF=[{")


def test_float_text_is_used_in_selected_values(spark, invoices):
    row = merged(invoices({"total_amount": 12345678.9}), invoices({"total_amount": 12345678.9}))[0]
    shown = next(c for c in row.field_comparisons if c.field_name == "total_amount")
    assert shown.selected_value == spark.range(1).select(py_float_text(F.lit(12345678.9))).first()[0] == "12345678.9"


def test_bounds_lie_above_the_similarity(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbcß İ1") for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "  ", "a" * 300]
    pairs = [(a, b) for a, b in zip(texts, rng.sample(texts, len(texts)), strict=True)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("*", F.lower("a").alias("l"), F.lower("b").alias("r"), similarity_bound(F.col("a"), F.col("b")).alias("bound"))
    decided = 0
    for r in rows.collect():
        compared = r.a is not None and r.b is not None and r.l != r.r and r.l.strip() and r.r.strip()
        assert (r.bound is not None) == bool(compared)
        if compared:
            ratio = SequenceMatcher(None, r.l, r.r).ratio()
            assert ratio <= r.bound + 1e-12
            decided += r.bound <= M.MIN_SIMILARITY
    assert decided > 300


def test_scores_are_those_of_the_merge(spark, invoices, monkeypatch):
    rng = random.Random(14)
    words = ["Acme Corp", "Acme Corp.", "ACME CORP", "Northwind", "Acme Corporation", "", " ", None, "North wind", "A-1", "A-2"]

    def some():
        texts = {f: rng.choice(words) for f in ("invoice_number", "vendor_name", "buyer_name", "due_date", "invoice_date")}
        amounts = {f: rng.choice([None, 0.0, 100.0, 104.0, 110.0, float("nan")]) for f in ("subtotal", "total_amount")}
        return texts | amounts | {"line_items": rng.choice([None, [], [ITEM], [ITEM, ITEM]])}

    left, right = invoices(*[some() for _ in range(300)]), invoices(*[some() for _ in range(290)])
    columns = ["invoice_id", "mismatch_count", "quality_score", "recommendation", "notes", "pdf_source", "google_source"]
    whole = M.merge_sources(left, right, AT).select(columns)
    scores = M.merge_scores(left, right, AT)
    assert scores.columns == columns
    assert sorted(map(str, scores.collect())) == sorted(map(str, whole.collect()))


def test_few_texts_reach_the_similarity(spark, data, monkeypatch):
    """Of the given tables' pairs the bounds decide all: none is handed to Python."""
    seen = []
    real = M.similarities

    def watched(pairs):
        seen.append(pairs)
        return real(pairs)

    monkeypatch.setattr(M, "similarities", watched)
    first = D.invoices(spark, data)
    M.merge_scores(first, D.second_source(first), AT)
    paired = M.pair_sources(first, D.second_source(first))
    texts = F.array(*[F.struct(F.col(f"l.{n}").alias("left"), F.col(f"r.{n}").alias("right")) for n in M.TEXT_FIELDS])
    bounds = F.transform("_texts", lambda t: similarity_bound(t["left"], t["right"]))
    rows = paired.withColumn("_texts", texts).withColumn("_bounds", bounds)
    handed = rows.select(F.explode(seen[0]).alias("p")).where("p is not null").count()
    differing = rows.select(F.explode("_bounds").alias("b")).where("b is not null").count()
    assert handed == 0 and differing > 100
