"""Uploads from file to store: routing, files, large JSON, sinks, pages and running summaries."""

import csv
import datetime as dt
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.operators import routing, stats, store, views
from tallybook.operators.validate import validate_invoices
from tallybook.plans.documents import process_uploads, upload_records
from tallybook.ranges import numbered
from tallybook.sources.files import read_invoice_files
from tallybook.sources.invoice_json import load_invoices, read_invoice_json
from tallybook.sources.json_arrays import read_json_records
from tallybook.streaming import intake

TEXT = "Some Trader\nInvoice #: INV-7\nTotal: $12\n"
CASES = [
    # requested, document ready, model ready, document error, model error, label, confidence, error
    ("auto", True, True, None, None, "Google Document AI", 95.0, None),
    ("auto", True, True, "quota", None, "Gemini Extraction (Fallback)", 85.0, None),
    ("auto", True, True, "quota", "no json", "PDF Extractor (Emergency Fallback)", 0.0, "no json"),
    ("auto", True, False, "quota", None, "PDF Extractor (Fallback)", 60.0, None),
    ("auto", False, True, None, None, "Gemini Extraction", 90.0, None),
    ("auto", False, True, None, "no json", "PDF Extractor (Emergency Fallback)", 0.0, "no json"),
    ("auto", False, False, None, None, "PDF Extractor (Regex)", 70.0, None),
    ("google_document_ai", False, True, None, None, "Google Document AI", 95.0, None),
    ("google_document_ai", True, True, "quota", None, "PDF Extractor (Emergency Fallback)", 0.0, "quota"),
    ("gemini_extraction", True, True, None, "no json", "PDF Extractor (Emergency Fallback)", 0.0, "no json"),
    ("pdf_extractor", True, True, None, None, "PDF Extractor (Regex)", 70.0, None),
    ("something", True, True, None, None, "PDF Extractor (Default)", 0.0, None),
    (None, True, True, None, None, "PDF Extractor (Default)", 0.0, None),
]


def uploaded(spark, cases, **answers):
    files = [(i, f"f{i}.pdf", 10, c[0], c[1], c[2]) for i, c in enumerate(cases)]
    schema = "file_id long, file_name string, length long, requested string, document_ready boolean, model_ready boolean"
    texts = spark.createDataFrame([(i, TEXT) for i in range(len(cases))], "file_id long, text string")
    return process_uploads(spark.createDataFrame(files, schema), texts, "2024-06-01", **answers)


def test_each_file_takes_its_own_way(spark):
    row = "file_id long, error string, invoice_number string, total_amount double"
    document = spark.createDataFrame([(i, c[3], None if c[3] else "DOC", 1.0) for i, c in enumerate(CASES)], row)
    model = spark.createDataFrame([(i, c[4], None if c[4] else "MODEL", 2.0) for i, c in enumerate(CASES)], row)
    got = uploaded(spark, CASES, document_answers=document, model_answers=model).orderBy("file_id").collect()
    for r, (*_, label, confidence, error) in zip(got, CASES, strict=True):
        assert (r.model_used, r.confidence, r.extraction_error) == (label, confidence, error)
        served = "DOC" if "Document" in label else "MODEL" if "Gemini" in label else "INV-7"
        assert r.invoice_number == served and r.success and r.error is None
        assert r.total_amount == {"DOC": 1.0, "MODEL": 2.0, "INV-7": 12.0}[served]


def test_services_without_answers_fail_softly(spark):
    got = uploaded(spark, CASES).orderBy("file_id").collect()
    assert {r.invoice_number for r in got} == {"INV-7"}
    assert [r.extraction_error for r in got[:4]] == ["No answer"] * 3 + [None]


def test_files_that_are_not_read(spark):
    names = ["a.jpg", "b.exe", "c.pdf", None, "d.pdf"]
    files = [(i, n, 0 if n == "c.pdf" else 5, "auto", None, None) for i, n in enumerate(names)]
    schema = "file_id long, file_name string, length long, requested string, document_ready boolean, model_ready boolean"
    texts = spark.createDataFrame([(0, TEXT), (1, TEXT)], "file_id long, text string")
    done = process_uploads(spark.createDataFrame(files, schema), texts, "2024-06-01")
    got = done.orderBy("file_id").collect()
    assert [(r.success, r.model_used, r.invoice_number, r.score) for r in got] == [
        (True, "unknown", None, 0), (False, None, None, None), (False, None, None, None), (False, None, None, None),
        (True, "PDF Extractor (Regex)", None, got[4].score),
    ]
    assert got[0].errors == ["File type not supported for extraction"] and got[4].score < 60
    stored = upload_records(done, "2024-06-01 00:00:00").orderBy("invoice_id").collect()
    assert [(r.invoice_id, r.file_name, r.currency, r.extraction_metadata.model_used) for r in stored] == [
        (0, "a.jpg", "USD", "unknown"), (4, "d.pdf", "EUR", "PDF Extractor (Regex)"),
    ]
    empty = spark.createDataFrame([], schema)
    assert process_uploads(empty, texts, "2024-06-01").collect() == []


def test_picking_names_the_cause(spark):
    rows = [(1, "gemini_extraction", False, "broken"), (1, "pdf_extractor", True, None), (2, "pdf_extractor", True, None), (3, "google_document_ai", False, None)]
    candidates = spark.createDataFrame(rows, "invoice_id long, method string, ok boolean, error string")
    got = {r.invoice_id: (r.model_used, r.error, r.method) for r in routing.pick_extraction(candidates).collect()}
    assert got[1] == ("PDF Extractor (Emergency Fallback)", "broken", "pdf_extractor")
    assert got[2] == ("PDF Extractor (Regex)", None, "pdf_extractor")
    assert got[3] == ("PDF Extractor (Emergency Fallback)", "Selected extraction failed", None)


# ---- JSON of any size ---------------------------------------------------------------------------


def documents():
    rng = random.Random(1)
    nasty = ["}", "{", "]", "[", '"', "\\", '\\"}', "a,b", "{]}", "é", "\n", "}{" * 30]
    long = [
        {"invoice_number": f"n{i}", "vendor_name": "".join(rng.choices(nasty, k=rng.randint(0, 4))),
         "line_items": [{"description": "}x{", "total": 1}] * rng.randint(0, 2)}
        for i in range(80)
    ]
    record = json.dumps({"invoice_number": 'x}{"[', "vendor_name": 'é\\"'})
    return {
        "object": record, "object_line": record + "\n", "array": json.dumps(long), "indented": json.dumps(long[:9], indent=2) + "\n \n",
        "raw": json.dumps(long[:30], ensure_ascii=False, separators=(",", ":")), "empty": "[]", "blank_array": " [ \n ] ",
        "numbers": "[1, 2, 3]", "mixed": '[1, {"invoice_number":"a"}, "x", {"invoice_number":"b"}, [3], null]',
        "nested": '[[{"invoice_number":"a"}], {"invoice_number":"b"}]', "scalar": "5", "one": '[{"invoice_number":"a"}]',
        "open": '[{"invoice_number":"a"}, {"invoice_number":"b"}', "comma": '[{"invoice_number":"a"},]',
        "no_comma": '[{"invoice_number":"a"} {"invoice_number":"b"}]', "behind": '[{"invoice_number":"a"}] {"x":1}',
        "comma_first": '[,{"invoice_number":"a"}]', "too_deep": '{"a":1}}', "string": '[{"a":"}]', "cut": '[{"invoice_number":"a"}, {"in',
        "two_commas": '[{"invoice_number":"a"},,{"invoice_number":"b"}]', "array_twice": '[{"invoice_number":"a"}][{"invoice_number":"b"}]',
    }


@pytest.mark.parametrize("split", ["120", "1000", "128m"])
def test_records_of_arrays_equal_whole_files(spark, tmp_path, split):
    for name, text in documents().items():
        (tmp_path / f"{name}.json").write_text(text)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        whole = spark.read.text(str(tmp_path), wholetext=True).withColumn("source_file", name)
        want = Counter(map(str, load_invoices(whole, "value").collect()))
        got = read_invoice_json(spark, str(tmp_path))
        assert Counter(map(str, got.select("source_file", *[c for c in got.columns if c != "source_file"]).collect())) == want
        if split == "120":
            sizes = read_json_records(spark, str(tmp_path / "array.json")).agg(F.count("*"), F.max(F.length("value"))).first()
            assert sizes[0] == 80 and sizes[1] < 1500
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


# ---- sinks --------------------------------------------------------------------------------------


def test_results_as_arrays(spark, tmp_path):
    rows = [(i, f'"{i}\n', [str(i)], "bad" if i % 4 == 0 else None) for i in range(50)]
    frame = spark.createDataFrame(rows, "invoice_id long, vendor_name string, errors array<string>, error string").repartition(3)
    views.write_results_json(frame, str(tmp_path / "out"), arrays=True)
    views.write_results_json(frame.where("false"), str(tmp_path / "none"), arrays=True)
    found = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert sorted(r["invoice_id"] for part in found for r in part) == [i for i in range(50) if i % 4]
    assert all(r["vendor_name"] == f'"{r["invoice_id"]}\n' and r["error"] is None for part in found for r in part)
    assert all(f.read_text() == "" for f in (tmp_path / "none").glob("part-*"))


def test_one_csv_an_invoice(spark, invoices, tmp_path):
    frame = invoices(*[{"invoice_number": f'N"{i}', "total_amount": 2.0 * i} for i in range(6)])
    views.write_field_value_csv(views.to_field_value(frame), str(tmp_path / "csv"), by_invoice=True)
    for i in range(6):
        (file,) = (tmp_path / "csv" / f"invoice_id={i}").glob("part-*")
        with open(file, newline="") as lines:
            read = list(csv.reader(lines))
        assert read[0] == ["Field", "Value"] and [r[0] for r in read[1:]] == [label for label, _ in views.EXPORT_FIELDS]
        assert read[1][1] == f'N"{i}' and dict(read)["Total Amount"] == ("" if i == 0 else str(2 * i))


def test_files_are_stored_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, content in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.pdf", b"two"), ("d.txt", b"no"), ("e.pdf", b"three")):
        (source / name).write_bytes(content)
    files = read_invoice_files(spark, str(source))
    kept = store.FileStore(spark, str(tmp_path / "store"))
    assert kept.references.count() == 0
    first = sorted(kept.put(files).collect())
    assert sorted(kept.put(files).collect()) == first and len(first) == 4
    (source / "f.pdf").write_bytes(b"two")
    again = store.FileStore(spark, str(tmp_path / "store"))
    assert again.put(read_invoice_files(spark, str(source))).count() == 5 and again.contents.count() == 3
    ids = spark.createDataFrame([(r.file_id,) for r in first] + [("none",), (None,)], "file_id string")
    found = {r.filename: r for r in again.get(ids).collect()}
    assert {n: bytes(found[n].content) for n in ("a.pdf", "b.pdf", "c.pdf", "e.pdf")} == {"a.pdf": b"one", "b.pdf": b"one", "c.pdf": b"two", "e.pdf": b"three"}
    assert found["a.pdf"].content_type == "application/pdf" and found[None].content is None


# ---- pages and summaries ------------------------------------------------------------------------


def test_pages_at_any_depth(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=rng.randrange(20))) for i in range(300)] + [(500 + i, None) for i in range(4)]
    frame = spark.createDataFrame(rows, "invoice_id long, created_at timestamp").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[0]), reverse=True)
    ids = [i for i, _ in order]
    index = store.index_pages(frame)
    for offset in (0, 7, 150, 290, 299, 304, 1000):
        assert [r.invoice_id for r in index.page(20, offset).collect()] == ids[offset : offset + 20]
    after, seen = None, []
    while page := store.next_page(frame, after, limit=70).collect():
        seen += [r.invoice_id for r in page]
        after = (page[-1].created_at, page[-1].invoice_id)
    assert seen == ids
    deep = index.page(5, 250)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__task", deep)


def test_numbered_spreads_equal_rows(spark):
    rows = spark.createDataFrame([("a", i % 5) for i in range(40)] + [("c", 1)] * 30, "g string, v int").repartition(6)
    got = numbered(rows, ["g"], ["v"]).collect()
    for name, n in (("a", 40), ("c", 30)):
        own = sorted((r.place, r.v, r.total) for r in got if r.g == name)
        assert [p for p, *_ in own] == list(range(n)) and {t for *_, t in own} == {n}
        assert [v for _, v, _ in own] == sorted(v for _, v, _ in own)


def test_summaries_add_up(spark, invoices, tmp_path):
    rng = random.Random(5)
    every = []
    for batch in range(3):
        records = [{"invoice_number": rng.choice(["INV-1", None]), "total_amount": rng.choice([1.005, 1e30, 0.1, None, float("inf")])} for _ in range(9)]
        done = validate_invoices(invoices(*records), "2024-01-01").select("is_valid", "score", "errors", "total_amount")
        done.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        every += records
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new the second time
        intake.append_summaries(stream, str(tmp_path / "sums"), str(tmp_path / "checkpoint"))
    batch = validate_invoices(invoices(*every), "2024-01-01")
    assert intake.summed_dashboard(spark, str(tmp_path / "sums")).collect() == stats.dashboard_stats(batch).collect()
    errors = intake.summed_error_counts(spark, str(tmp_path / "sums")).collect()
    assert sorted(errors) == sorted(stats.error_counts(batch).collect())
