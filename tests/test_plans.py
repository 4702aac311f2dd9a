"""Physical plans: what must not shuffle does not, and what must be pruned is."""

import re

from pyspark.sql import functions as F

from tallybook.functions import jsonvalues as J
from tallybook.functions import patterns as P
from tallybook.functions.pycompat import first_capture, fold, py_float, py_one_decimal
from tallybook.operators import basic_extract as X
from tallybook.operators import layout_extract as L
from tallybook.operators import reconcile as M
from tallybook.operators import stats
from tallybook.operators.basic_extract import extract_basic
from tallybook.operators.reconcile import merge_sources
from tallybook.operators.routing import pick_extraction
from tallybook.operators.validate import rule_hits, validate_invoices
from tallybook.plans.catalog import QUERIES
from tallybook.sources import derived as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table_of_invoices(spark, data, tmp_path):
    path = str(tmp_path / "invoices")
    D.invoices(spark, data).write.parquet(path)
    return spark.read.parquet(path)


def test_validation_is_narrow(spark, data, tmp_path):
    df = table_of_invoices(spark, data, tmp_path)
    for result in (validate_invoices(df, "2000-06-30"), rule_hits(df, "2000-06-30")):
        text = plan(result)
        assert "Exchange" not in text and "BatchEvalPython" not in text
    native = plan(validate_invoices(df, "2000-06-30", unusual_dates=False))
    assert "Python" not in native and "Exchange" not in native


def test_dashboard_reads_only_its_columns(spark, data, tmp_path):
    stored = validate_invoices(table_of_invoices(spark, data, tmp_path), "2000-06-30")
    path = str(tmp_path / "stored")
    stored.write.parquet(path)
    text = plan(stats.dashboard_stats(spark.read.parquet(path)))
    assert re.search(r"ReadSchema: struct<total_amount:double,is_valid:boolean,score:int>", text)


def test_extraction_is_narrow(spark, data, tmp_path):
    path = str(tmp_path / "texts")
    D.texts(spark, data).write.parquet(path)
    texts = spark.read.parquet(path)
    for result in (extract_basic(texts), L.extract_layout(texts)):
        text = plan(result)
        assert "Exchange" not in text and "Python" not in text


def test_first_words_are_limited_before_the_shuffle(spark, data):
    text = plan(L.vendor_from_words(D.words(D.texts(spark, data))))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_merge_shuffles_once_per_side(spark, data, tmp_path):
    df = table_of_invoices(spark, data, tmp_path)
    keyed = df.filter("invoice_id is not null")
    text = plan(merge_sources(keyed, keyed, "2000-06-30").select("invoice_id", "vendor_name"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("Exchange hashpartitioning") <= 2


def test_pick_is_one_aggregate(spark, data, tmp_path):
    path = str(tmp_path / "candidates")
    D.candidates(D.invoices(spark, data)).write.parquet(path)
    text = plan(pick_extraction(spark.read.parquet(path)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_" in text


def test_no_query_uses_a_cross_join(spark, data):
    for name, build in QUERIES.items():
        if not name.startswith("ss_"):
            text = plan(build(spark, data))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_page_is_a_top_n(spark, data):
    text = plan(QUERIES["st_page"](spark, data).filter(F.lit(True)))
    assert "TakeOrderedAndProject" in text


def test_merge_reads_its_inputs_once(spark, data):
    text = plan(QUERIES["m_quality"](spark, data))
    assert text.count("Scan parquet") <= 10
    assert text.count("ArrowEvalPython") <= 1


def test_merge_strips_texts_before_the_comparison(spark):
    """Lambdas are interpreted: whether a side has a value is found once, and not by each part of an entry."""
    entry = M._compare_text(F.col("entry"), F.col("ratio"))._jc.toString()
    assert "trim" not in entry


def test_one_decimal_goes_through_decimals_near_midpoints_only(spark):
    values = [0.0, 0.04, 0.05, 0.15, 0.25, 0.35, 72.04, 72.05, 99.95, 99.949, 85.0, 1e5 + 0.05, 999999.94, 999999.96, 1e6, 12345678.25, 4.9999999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(py_one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in values]
    shown = py_one_decimal(F.col("v"))._jc.toString()
    assert shown.startswith("CASE WHEN") and "decimal" not in shown.lower().split(" else ")[0]


def test_json_values_are_described_once(spark):
    for read in (J.as_text, J.as_float, J.is_truthy):
        assert read(F.col("v"))._jc.toString().count("schema_of_variant") == 1
    assert J.strict_json(F.col("t"))._jc.toString().count("try_parse_json") == 1
    assert py_float(F.col("t"))._jc.toString().count("btrim") == 1


def test_captures_search_once(spark):
    """A text is searched once by a pattern that matches, and not a second time to see whether it did."""
    texts = spark.createDataFrame([(1, "Ort\nİK Invoice #: A-1\nsubTotal: $9.50\nTOTAL: 1,200.5\n"), (2, "No total"), (3, None)], "i int, text string")
    texts = texts.withColumn("folded", fold(F.col("text")))
    text, folded = F.col("text"), F.col("folded")
    found = texts.select(
        "i",
        X.invoice_number(text, folded).alias("number"),
        L.amount_layout(text, P.LAYOUT_TOTAL, folded).alias("total"),
        X.amount(text, P.TOTAL_AMOUNT, "normalized", "(?<!sub)", folded).alias("whole"),
    )
    assert [tuple(r)[1:] for r in found.orderBy("i").collect()] == [("A-1", 9.5, 1200.5), (None, None, None), (None, None, None)]
    optimized = texts.select(first_capture(text, P.INVOICE_NUMBER, folded=folded).alias("number"))._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract(") == len(P.INVOICE_NUMBER)


def test_first_usable_line(spark):
    rows = [(1, "\n  \nDate\n ab \n Mill & Co \nother"), (2, "\n" * 9 + "Tenth line"), (3, "\n" * 10 + "Eleventh line"), (4, None), (5, "")]
    texts = spark.createDataFrame(rows, "i int, text string")
    got = texts.orderBy("i").select(L.fallback_vendor(F.col("text")), X.vendor_name(X.lines_of(F.col("text")))).collect()
    assert [tuple(r) for r in got] == [("Mill & Co", "Mill & Co"), ("Tenth line", "Tenth line"), (None, None), (None, None), (None, None)]
    assert "filter(" not in L.fallback_vendor(F.col("text"))._jc.toString()


def test_generated_methods_can_be_compiled(spark, data, tmp_path):
    """The JVM's JIT compiler skips methods of more than 8,000 bytes."""
    path = str(tmp_path / "texts")
    D.texts(spark, data).write.parquet(path)
    read = validate_invoices(extract_basic(spark.read.parquet(path)), "2000-06-30").select("invoice_id", "is_valid", "score")
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(read._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000
