"""Loading, responses, files, store and exports on small fixtures."""

import csv
import json

from pyspark.sql import functions as F

from tallybook.operators import responses as R
from tallybook.operators import stats, store, views
from tallybook.operators.validate import validate_invoices
from tallybook.plans.catalog import QUERIES
from tallybook.plans.documents import process_documents
from tallybook.sources import derived as D
from tallybook.sources import files as S
from tallybook.sources import invoice_json as J
from tallybook.streaming.intake import validate_stream


def load(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    return J.load_invoices(df).orderBy("i").collect()


def test_strict_load_types(spark):
    cases = {
        '{"subtotal":"12.5"}': 12.5,
        '{"subtotal":" 5 "}': 5.0,
        '{"subtotal":true}': 1.0,
        '{"subtotal":7}': 7.0,
        '{"subtotal":null}': None,
        '{"unknown":{"a":[1]}}': None,
    }
    rows = load(spark, *cases)
    assert [r.load_error for r in rows] == [None] * len(cases)
    assert [r.subtotal for r in rows] == list(cases.values())


def test_strict_load_errors(spark):
    bad = [
        '{"subtotal":"1,2"}',
        '{"invoice_number":1}',
        '{"line_items":[{"description":null}]}',
        '{"line_items":[{"description":"a","total":"x"}]}',
        '{"line_items":[3]}',
        '{"line_items":"x"}',
        '{"subtotal":[1]}',
        '{"currency":true}',
        "[1]",
        "{",
        '{"a":1} trailing',
        "",
    ]
    rows = load(spark, *bad)
    assert len(rows) == len(bad) and all(r.load_error for r in rows)
    assert all(r.invoice_number is None and r.subtotal is None for r in rows)


def test_strict_load_items_and_arrays(spark):
    text = '[{"line_items":[{"description":"a","quantity":"2","price":null}]},{"line_items":null},{}]'
    rows = load(spark, text)
    assert [r.load_error for r in rows] == [None] * 3
    items = sorted((r.line_items for r in rows), key=str)
    assert items == sorted([[("a", 2.0, None, None)], None, []], key=str)


def test_read_json_files_and_summary(spark, tmp_path):
    good = {"invoice_number": "INV-1", "vendor_name": "V", "invoice_date": "2024-01-01", "total_amount": 5}
    (tmp_path / "a.json").write_text(json.dumps([good, {"invoice_number": 5}], indent=2))
    (tmp_path / "b.json").write_text(json.dumps({**good, "source_file": "x", "extraction_metadata": {}}))
    loaded = J.read_invoice_json(spark, str(tmp_path))
    assert sorted(r.source_file for r in loaded.collect()) == ["a.json", "a.json", "b.json"]
    row = stats.load_summary(validate_stream(loaded, "2024-06-01")).first()
    assert (row.valid, row.total, row.unreadable) == (2, 3, 1)
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "c.json").write_text("\n".join([json.dumps(good), "", "{"]))
    by_line = J.read_invoice_json(spark, str(lines), lines=True).collect()
    assert sorted(r.load_error or "" for r in by_line) == ["", "Malformed JSON"]


def test_fences(column):
    texts = ['```json\n{"a":1}\n```', '```\n{}\n```', "{}", '```json```{"a":1}```', " x ``` y "]
    assert column(texts, R.strip_fences) == ['{"a":1}', "{}", "{}", '{"a":1}', "x ``` y"]
    assert column(texts, R.drop_fences) == ['{"a":1}', "{}", "{}", '{"a":1}', "x  y"]
    assert column(['a {"x":{}} b } c', "} {", "none"], R.braced) == ['{"x":{}} b }', None, None]


def test_lenient_mapping(spark):
    record = {
        "invoice_number": 12,
        "vendor_name": "",
        "buyer_name": 1.5,
        "currency": True,
        "due_date": 0,
        "subtotal": "1,2",
        "tax_amount": "7",
        "total_amount": False,
        "line_items": [{"description": "a", "total": "x"}, {"description": None}, 3, {"description": "b", "quantity": 1}],
    }
    texts = [json.dumps(record), "no json", "{broken}", '{"a": 1}', "{open"]
    df = spark.createDataFrame([(i, f"Sure: {t} ok") for i, t in enumerate(texts)], "i int, response string")
    rows = R.parse_responses(df).orderBy("i").collect()
    first = rows[0]
    assert (first.invoice_number, first.vendor_name, first.buyer_name, first.currency) == ("12", None, "1.5", "True")
    assert (first.due_date, first.subtotal, first.tax_amount, first.total_amount) == (None, None, 7.0, 0.0)
    assert first.line_items == [("a", None, None, None), ("b", 1.0, None, None)]
    assert [r.parsed for r in rows] == [True, True, False, True, True]
    assert rows[1].line_items == [] and rows[1].invoice_number is None


def test_gst_round(spark):
    record = {"supplier_name": " A  B ", "invoice_date": "13/02/2024", "total_amount": "₹ 1,200.50", "items": [{"amount": 5.0}, 7]}
    df = spark.createDataFrame([(1, json.dumps(record))], "invoice_id int, response string")
    gst = R.parse_responses(df, shape="gst")
    row = R.gst_json(gst).first()
    assert json.loads(row.json) == {
        "supplier_name": "A B",
        "invoice_date": "2024-02-13",
        "items": [{"amount": "5.0"}],
        "total_amount": "1200.50",
    }
    core = R.gst_to_invoice(gst).first()
    assert (core.vendor_name, core.total_amount, core.line_items) == (None, 1200.5, [])
    assert R.gst_to_invoice(gst, map_parties=True).first().vendor_name == "A B"


def test_entities(spark):
    rows = [
        (1, 1, "vendor_name", " First ", 0.9),
        (1, 2, "supplier_name", "Second", 0.71),
        (1, 3, "supplier_name", "Unsure", 0.7),
        (1, 4, "total_amount", "5", 0.9),
        (1, 5, "total_amount", None, 0.9),
        (1, 6, "page", "x", 0.9),
        (2, 1, "due_date", "x", 0.1),
    ]
    df = spark.createDataFrame(rows, "invoice_id int, ord int, type string, value string, confidence double")
    got = {r.invoice_id: r for r in R.entities_to_invoice(df).collect()}
    assert (got[1].supplier_name, got[1].total_amount, got[2].due_date) == ("Second", None, None)


def test_files_scan_and_store(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"same")
    (tmp_path / "b.pdf").write_bytes(b"same")
    (tmp_path / "c.PDF").write_bytes(b"upper")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"deep")
    scanned = S.read_invoice_files(spark, str(tmp_path))
    assert sorted(r.source_file for r in scanned.collect()) == ["a.pdf", "b.pdf"]
    stored = store.to_file_store(scanned).collect()
    assert len({r.file_id for r in stored}) == 2 and {r.content_type for r in stored} == {"application/pdf"}
    assert {r.length for r in stored} == {4}


def test_gate(spark):
    limit = 35 * 1024 * 1024
    rows = [("", 1), (None, 1), ("a.txt", 1), ("a.PDF", limit), ("a.jpeg", limit + 131072), ("a.docx", 0), ("a.pdf", limit + 1)]
    df = spark.createDataFrame(rows, "file_name string, length bigint")
    got = [r.error for r in S.gate_files(df).collect()]
    assert got == [
        S.NO_NAME,
        S.NO_NAME,
        S.UNSUPPORTED,
        None,
        "File size (35.12MB) exceeds 35MB limit",
        S.EMPTY_FILE,
        "File size (35.00MB) exceeds 35MB limit",
    ]


def test_documents_account_for_every_file(spark):
    files = spark.createDataFrame(
        [(1, "a.pdf", 10), (2, "b.png", 10), (3, "c.txt", 10), (4, "d.pdf", 0), (5, "e.pdf", 5)],
        "file_id int, file_name string, length bigint",
    )
    texts = spark.createDataFrame([(1, "Acme\nInvoice # INV-9\nTotal: 5")], "file_id int, text string")
    rows = {r.file_id: r for r in process_documents(files, texts, "2024-01-01").collect()}
    assert [rows[i].success for i in range(1, 6)] == [True, True, False, False, True]
    assert rows[1].invoice_number == "INV-9" and rows[1].total_amount == 5.0 and rows[1].needs_ocr
    assert rows[2].errors == ["File type not supported for extraction"] and rows[2].score == 0
    assert rows[3].error == S.UNSUPPORTED and rows[3].score is None and rows[3].currency is None
    assert rows[5].currency == "EUR" and rows[5].invoice_number is None
    summary = stats.batch_summary(process_documents(files, texts, "2024-01-01", method="layout")).first()
    assert (summary.total_files, summary.successful, summary.failed, summary.success_rate) == (5, 3, 2, 60.0)


def test_empty_tables_give_zeros(invoices):
    empty = validate_invoices(invoices({}), "2024-01-01").filter("false")
    dashboard = stats.dashboard_stats(empty).first()
    assert tuple(dashboard)[:5] == (0, 0, 0, 0.0, 0.0) and dashboard.unsummed_amounts == 0
    assert dashboard.average_validation_score == 0.0 and dashboard.total_amount == 0.0
    assert stats.batch_summary(empty.withColumn("success", F.lit(True))).first().success_rate == 0.0


def test_store_lookup(spark, invoices):
    stored = store.to_store(invoices({"currency": ""}, {"currency": "EUR"}), "2024-01-01 10:00:00")
    rows = stored.orderBy("invoice_id").collect()
    assert [r.currency for r in rows] == ["USD", "EUR"] and rows[0].validation_score == 0 and not rows[0].is_valid
    assert store.get_invoice(stored, "1").count() == 1 and store.get_invoice(stored, "x1").count() == 0
    assert [r.invoice_id for r in store.list_page(stored, 1, 1).collect()] == [0]
    assert views.result_view(stored).first().errors == []


def test_exports(spark, invoices, tmp_path):
    df = invoices({"invoice_number": 'A "q"', "subtotal": 1000.0, "tax_amount": 0.5})
    views.write_field_value_csv(views.to_field_value(df).coalesce(1).orderBy("position"), str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("*.csv"))
    rows = list(csv.reader(part.open(encoding="utf8")))
    assert rows[0] == ["invoice_id", "position", "Field", "Value"] and rows[1] == ["0", "1", "Invoice Number", 'A "q"']
    assert rows[7] == ["0", "7", "Subtotal", "1000"] and rows[8] == ["0", "8", "Tax Amount", "0.5"]
    views.write_results_json(df.withColumn("error", F.lit(None).cast("string")), str(tmp_path / "json"))
    (line,) = [line for part in (tmp_path / "json").glob("*.json") for line in part.read_text().splitlines()]
    record = json.loads(line)
    assert record["invoice_number"] == 'A "q"' and record["vendor_name"] is None


def test_pages_in_order(spark):
    rows = [(1, i, f"p{i};") for i in range(12)] + [(2, 0, None), (2, 1, "x")]
    pages = spark.createDataFrame(rows, "invoice_id int, page int, text string").repartition(5)
    got = {r.invoice_id: r.text for r in S.assemble_text(pages).collect()}
    assert got == {1: "".join(f"p{i};" for i in range(12)), 2: "x"}
    assert {r.text for r in S.assemble_text(pages, "\n").collect()} == {"".join(f"p{i};\n" for i in range(12)), "\nx\n"}


def test_words_are_made_in_small_parts(spark, data, monkeypatch):
    monkeypatch.setattr(D, "TEXTS_PER_TASK", 20)
    texts = D.texts(spark, data)
    n = texts.count()
    for df in (D.in_small_parts(texts, data), D.words(D.in_small_parts(texts, data))):
        parts = df.groupBy(F.spark_partition_id()).agg(F.countDistinct("invoice_id").alias("n")).collect()
        assert sum(r.n for r in parts) == n and max(r.n for r in parts) <= 60
    for name in ("lx_vendor_words", "lx_invoice"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(invoice_id#" in plan and f", {-(-n // 20)}), REPARTITION_BY_NUM" in plan
