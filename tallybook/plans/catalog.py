"""The registered queries: one per operator, each over whole tables.

Every entry takes a session and the folder of the input tables and returns a DataFrame of flat
columns, so that results can be compared with the SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import normalize as N
from tallybook.functions import patterns as P
from tallybook.operators import basic_extract as X
from tallybook.operators import layout_extract as L
from tallybook.operators import reconcile as M
from tallybook.operators import responses as R
from tallybook.operators import routing, stats, store, verify, views
from tallybook.operators.validate import rule_hits, score_band, validate_invoices
from tallybook.plans.documents import process_documents, unsupported_result
from tallybook.ranges import written
from tallybook.session import shared_folder
from tallybook.sources import derived as D
from tallybook.sources import files as S
from tallybook.sources import invoice_json as J
from tallybook.sources.tables import spread, table
from tallybook.streaming import intake

AS_OF = "2000-06-30"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    return validate_invoices(D.invoices(spark, folder), AS_OF)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    valid = validate_invoices(D.stored_invoices(D.invoices(spark, folder)), AS_OF)
    return store.to_store(valid, F.col("created_at"))


def _joined(c: str) -> Column:
    return F.array_join(c, " | ")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


# ---- validation ---------------------------------------------------------------------------


@query
def v_result(spark: SparkSession, folder: str) -> DataFrame:
    return _validated(spark, folder).select(
        "invoice_id",
        "invoice_number",
        "is_valid",
        "score",
        F.size("errors").alias("n_errors"),
        F.size("warnings").alias("n_warnings"),
    )


@query
def v_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _validated(spark, folder).select(
        "invoice_id", _joined("errors").alias("errors"), _joined("warnings").alias("warnings")
    )


@query
def v_rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    return rule_hits(D.invoices(spark, folder), AS_OF)


@query
def v_high_amount(spark: SparkSession, folder: str) -> DataFrame:
    hits = rule_hits(D.invoices(spark, folder), AS_OF, documented_high_amount=True)
    return hits.filter(F.col("rule").isin("V18", "V19")).select("invoice_id", "rule", "severity", "penalty")


@query
def v_bands(spark: SparkSession, folder: str) -> DataFrame:
    banded = _validated(spark, folder).select(score_band(F.col("score")).alias("band"))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


# ---- summaries ----------------------------------------------------------------------------


@query
def ag_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    return stats.dashboard_stats(_validated(spark, folder))


@query
def ag_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.validation_summary(_validated(spark, folder))


@query
def ag_error_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.error_counts(_validated(spark, folder))


@query
def ag_load_summary(spark: SparkSession, folder: str) -> DataFrame:
    loaded = J.load_invoices(json_records(spark, folder), "record")
    return stats.load_summary(intake.validate_stream(loaded, AS_OF))


@query
def ag_verify_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.verification_stats(verify.verify(D.invoices(spark, folder)))


@query
def ag_batch(spark: SparkSession, folder: str) -> DataFrame:
    gated = S.gate_files(D.files(spark, folder))
    return stats.batch_summary(gated.withColumn("success", F.col("error").isNull()))


@query
def ag_batch_errors(spark: SparkSession, folder: str) -> DataFrame:
    gated = S.gate_files(D.files(spark, folder))
    return stats.batch_errors(gated.withColumn("success", F.col("error").isNull()))


@query
def ag_completeness(spark: SparkSession, folder: str) -> DataFrame:
    counted = stats.completeness(D.invoices(spark, folder))
    return counted.select("invoice_id", "extracted_fields", "source_confidence", "is_complete")


# ---- verification ---------------------------------------------------------------------------


@query
def g_verify(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify(D.invoices(spark, folder)).select(
        "invoice_id",
        "verified_number",
        "status",
        "overall_confidence",
        "summary",
        _joined("critical_issues").alias("critical_issues"),
    )


@query
def g_verify_fields(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify_fields(D.invoices(spark, folder)).select(
        "invoice_id", "field_name", "original_value", "corrected_value", "confidence", "source", "requires_review"
    )


@query
def g_recommend(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify_and_validate(D.invoices(spark, folder), AS_OF).select(
        "invoice_id",
        "score",
        "status",
        "requires_review",
        "approval_ready",
        "confidence_level",
        _joined("required_actions").alias("required_actions"),
    )


# ---- store and views ------------------------------------------------------------------------


@query
def st_store(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder).select(
        "invoice_id",
        "invoice_number",
        "currency",
        "is_valid",
        "validation_score",
        F.size("validation_errors").alias("n_errors"),
        F.size("validation_warnings").alias("n_warnings"),
        "file_id",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
    )


@query
def st_get(spark: SparkSession, folder: str) -> DataFrame:
    return store.get_invoice(_stored(spark, folder), "1234").select("invoice_id", "invoice_number", "validation_score")


@query
def st_page(spark: SparkSession, folder: str) -> DataFrame:
    return store.list_page(_stored(spark, folder), limit=100, offset=40).select("invoice_id", "invoice_number")


@query
def st_page_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return store.page_envelope(D.invoices(spark, folder), limit=100, offset=40)


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    """Requested ids: every customer's number, of which some are invoice ids."""
    return table(spark, folder, "customer").select((F.col("c_custkey") * 17).alias("invoice_id"))


@query
def st_delete(spark: SparkSession, folder: str) -> DataFrame:
    invoices, ids = D.stored_invoices(D.invoices(spark, folder)), _wanted(spark, folder)
    return store.delete_invoices(invoices, D.files(spark, folder), ids)[0].select("invoice_id", "invoice_number")


@query
def st_delete_files(spark: SparkSession, folder: str) -> DataFrame:
    invoices, ids = D.stored_invoices(D.invoices(spark, folder)), _wanted(spark, folder)
    return store.delete_invoices(invoices, D.files(spark, folder), ids)[1].select("file_id", "length")


@query
def st_delete_outcome(spark: SparkSession, folder: str) -> DataFrame:
    invoices, ids = D.stored_invoices(D.invoices(spark, folder)), _wanted(spark, folder)
    return store.delete_invoices(invoices, D.files(spark, folder), ids)[2]


@query
def st_file_lookup(spark: SparkSession, folder: str) -> DataFrame:
    invoices, ids = D.stored_invoices(D.invoices(spark, folder)), _wanted(spark, folder)
    return store.file_lookup(invoices, D.files(spark, folder), ids).select("invoice_id", "status", "file_name")


@query
def st_list_view(spark: SparkSession, folder: str) -> DataFrame:
    return views.list_view(_stored(spark, folder))


@query
def st_result_view(spark: SparkSession, folder: str) -> DataFrame:
    return views.result_view(_stored(spark, folder)).select(
        "invoice_id",
        "is_valid",
        "score",
        _joined("errors").alias("errors"),
        F.col("extracted_data.vendor_name").alias("vendor_name"),
        F.col("extracted_data.total_amount").alias("total_amount"),
    )


@query
def csv_long(spark: SparkSession, folder: str) -> DataFrame:
    return views.to_field_value(D.invoices(spark, folder))


# ---- files and text ---------------------------------------------------------------------------


@query
def src_gate(spark: SparkSession, folder: str) -> DataFrame:
    return S.gate_files(D.files(spark, folder)).select("file_id", "error")


@query
def src_gate_pdf(spark: SparkSession, folder: str) -> DataFrame:
    gated = S.gate_files(D.files(spark, folder), "single").withColumnRenamed("error", "single_error")
    for intake_kind in S.PDF_ONLY:
        gated = S.gate_files(gated, intake_kind).withColumnRenamed("error", f"{intake_kind}_error")
    return gated.select("file_id", "single_error", "merge_error", "document_error", "layout_error")


@query
def src_type(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("file_name")
    return D.files(spark, folder).select(
        "file_id", S.file_type(name).alias("file_type"), S.content_type(name).alias("content_type")
    )


@query
def src_unsupported(spark: SparkSession, folder: str) -> DataFrame:
    accepted = S.gate_files(D.files(spark, folder)).filter(F.col("error").isNull())
    return unsupported_result(accepted).select("file_id", "is_valid", "score", _joined("errors").alias("errors"))


@query
def src_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.pages(D.texts(spark, folder))
    plain = S.assemble_text(pages)
    return plain.select("invoice_id", "text")


@query
def src_text_layout(spark: SparkSession, folder: str) -> DataFrame:
    return S.assemble_text(D.pages(D.texts(spark, folder)), "\n")


@query
def src_needs_ocr(spark: SparkSession, folder: str) -> DataFrame:
    return D.pages(D.texts(spark, folder)).select("invoice_id", "page", S.needs_ocr(F.col("text")).alias("needs_ocr"))


@query
def src_documents_ocr(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", S.needs_ocr(F.col("text")).alias("needs_ocr"))


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices as JSON records: well-typed, with a wrong type, in an array, or malformed."""
    invoices = D.invoices(spark, folder)
    key = F.col("invoice_id")
    good = F.to_json(
        F.struct(
            "invoice_number",
            "vendor_name",
            "invoice_date",
            F.col("due_date"),
            F.col("total_amount").cast("decimal(18,2)").cast("string").alias("total_amount"),
            F.lit("kept apart").alias("unknown_key"),
        )
    )
    record = (
        F.when(key % 11 == 0, F.concat(F.lit('{"invoice_number": '), key.cast("string"), F.lit("}")))
        .when(key % 13 == 0, F.concat(good, F.lit(" trailing")))
        .when(key % 17 == 0, F.concat(F.lit('{"vendor_name": "V", "subtotal": "1,'), key.cast("string"), F.lit('"}')))
        .when(key % 7 == 0, F.concat(F.lit("["), good, F.lit(","), good, F.lit("]")))
        .otherwise(good)
    )
    return invoices.select("invoice_id", record.alias("record"))


@query
def src_json(spark: SparkSession, folder: str) -> DataFrame:
    return J.load_invoices(json_records(spark, folder), "record").select(
        "invoice_id", "invoice_number", "vendor_name", "due_date", _money("total_amount").alias("total_amount"), "load_error"
    )


# ---- normalisers ------------------------------------------------------------------------------


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy spellings of every order's date and amount."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    shape = key % 8
    date = (
        F.when(shape == 0, F.date_format(day, "MM/dd/yyyy"))
        .when(shape == 1, F.date_format(day, "dd-MM-yyyy"))
        .when(shape == 2, F.date_format(day, "dd.MM.yyyy"))
        .when(shape == 3, F.date_format(day, "yyyy/MM/dd"))
        .when(shape == 4, F.date_format(day, "MMMM d, yyyy"))
        .when(shape == 5, F.date_format(day, "d MMM yyyy"))
        .when(shape == 6, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("  week of "), F.date_format(day, "yyyy")))
    )
    figure = (
        F.when(shape == 0, F.concat(F.lit("$"), amount))
        .when(shape == 1, F.concat(F.lit("€ 1,"), amount))
        .when(shape == 2, F.concat(F.lit("-"), amount))
        .when(shape == 3, F.concat(amount, F.lit(" USD")))
        .when(shape == 4, F.concat(F.lit("1.2."), amount))
        .when(shape == 5, F.lit("n/a"))
        .when(shape == 6, F.lit(""))
        .otherwise(F.concat(F.lit("1,"), amount))
    )
    return spread(table(spark, folder, "orders")).select(
        key.alias("invoice_id"), date.alias("date"), figure.alias("amount"), F.col("o_orderpriority").alias("priority")
    )


@query
def n_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", N.normalize_text(F.col("text")).alias("text"))


@query
def n_date(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder).select("invoice_id", N.normalize_date(F.col("date")).alias("date"))


@query
def n_amount(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder).select("invoice_id", N.normalize_amount(F.col("amount")).alias("amount"))


@query
def n_gst(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("29ab-"), F.col("priority"), F.lit(" "), F.col("invoice_id").cast("string"))
    gst = N.normalize_gst(raw)
    return _samples(spark, folder).select(
        "invoice_id", gst.alias("gst"), N.gst_well_formed(gst).alias("gst_ok")
    )


@query
def n_layout_date(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder).select("invoice_id", N.to_layout_date(F.col("date")).alias("date"))


@query
def n_amount_basic(spark: SparkSession, folder: str) -> DataFrame:
    captured = F.regexp_extract("amount", r"([0-9,]+\.?[0-9]*)", 1)
    return _samples(spark, folder).select("invoice_id", N.parse_amount_basic(captured).alias("amount"))


@query
def n_amount_norm(spark: SparkSession, folder: str) -> DataFrame:
    captured = F.regexp_extract("amount", r"([0-9,]+\.?[0-9]*)", 1)
    return _samples(spark, folder).select("invoice_id", N.parse_amount_normalized(captured).alias("amount"))


@query
def n_currency(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return D.texts(spark, folder).select(
        "invoice_id", N.currency_basic(text).alias("basic"), N.currency_layout(text).alias("layout")
    )


@query
def n_model_invoice(spark: SparkSession, folder: str) -> DataFrame:
    parsed = R.parse_responses(D.responses(D.invoices(spark, folder)), fences="braces")
    return parsed.select(
        "invoice_id", "parsed", "invoice_number", "vendor_name", "currency", "due_date", _money("total_amount").alias("total_amount")
    )


# ---- basic extraction -----------------------------------------------------------------------


def _from_text(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return D.texts(spark, folder).select("invoice_id", *[c.alias(n) for n, c in columns.items()])


@query
def x_number(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, invoice_number=X.invoice_number(F.col("text")))


@query
def x_vendor(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, vendor_name=X.vendor_name(X.lines_of(F.col("text"))))


@query
def x_vendor_documents(spark: SparkSession, folder: str) -> DataFrame:
    vendor = X.vendor_name(X.lines_of(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", vendor.alias("vendor_name"))


@query
def x_buyer(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, buyer_name=X.buyer_name(F.col("text")))


@query
def x_vendor_addr(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, vendor_address=X.vendor_address(X.lines_of(F.col("text"))))


@query
def x_buyer_addr(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, buyer_address=X.buyer_address(F.col("text")))


@query
def x_dates(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return _from_text(
        spark,
        folder,
        invoice_date=X.date_text(text, P.INVOICE_DATE_LINE),
        due_date=X.date_text(text, P.DUE_DATE_LINE),
    )


@query
def x_amounts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return _from_text(
        spark,
        folder,
        total_amount=X.amount(text, P.TOTAL_AMOUNT),
        subtotal=X.amount(text, P.SUBTOTAL),
        tax_amount=X.amount(text, P.TAX_AMOUNT),
    )


@query
def x_amounts_normalized(spark: SparkSession, folder: str) -> DataFrame:
    fixed = X.extract_basic(D.texts(spark, folder), amounts="normalized", fix_subtotal=True)
    return fixed.select("invoice_id", "total_amount", "subtotal", "tax_amount")


@query
def x_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, payment_terms=X.payment_terms(F.col("text")))


@query
def x_items(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sheets = D.item_sheets(spark, folder).withColumn("item", F.explode(X.line_items(F.col("text"))))
    return sheets.select(*keys, "item.description", "item.quantity", "item.price", "item.total")


@query
def x_invoice(spark: SparkSession, folder: str) -> DataFrame:
    """Basic extraction of every field, then validation of what was read."""
    validated = validate_invoices(X.extract_basic(D.texts(spark, folder)), AS_OF)
    return validated.select(
        "invoice_id", "invoice_number", "vendor_name", "buyer_name", "total_amount", "is_valid", "score"
    )


# ---- layout extraction ------------------------------------------------------------------------


@query
def lx_vendor_words(spark: SparkSession, folder: str) -> DataFrame:
    return L.vendor_from_words(D.words(D.in_small_parts(D.texts(spark, folder), folder)))


@query
def lx_buyer(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(
        spark,
        folder,
        buyer_name=L.buyer_layout(F.col("text")),
        fallback=L.fallback_buyer(F.col("text")),
    )


@query
def lx_number(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, invoice_number=L.number_layout(F.col("text")))


@query
def lx_dates(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return _from_text(
        spark,
        folder,
        invoice_date=L.date_layout(text, P.LAYOUT_INVOICE_DATE_LINE),
        due_date=L.date_layout(text, P.LAYOUT_DUE_DATE_LINE),
    )


@query
def lx_amounts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return _from_text(
        spark,
        folder,
        total_amount=L.amount_layout(text, P.LAYOUT_TOTAL),
        subtotal=L.amount_layout(text, P.LAYOUT_SUBTOTAL),
        tax_amount=L.amount_layout(text, P.LAYOUT_TAX),
    )


@query
def lx_fallback_vendor(spark: SparkSession, folder: str) -> DataFrame:
    return _from_text(spark, folder, vendor_name=L.fallback_vendor(F.col("text")))


@query
def lx_invoice(spark: SparkSession, folder: str) -> DataFrame:
    """Layout extraction with words and model answers, flattened with confidences."""
    invoices = D.invoices(spark, folder)
    texts = D.invoice_text(invoices)
    model = R.parse_responses(D.responses(invoices), fences="anywhere").drop("parsed")
    merged = L.extract_layout(texts, D.words(D.in_small_parts(texts, folder)), model)
    return merged.select(
        "invoice_id",
        "invoice_number",
        "vendor_name",
        "buyer_name",
        "currency",
        _money("subtotal").alias("subtotal"),
        _money("tax_amount").alias("tax_amount"),
        _money("total_amount").alias("total_amount"),
        *[F.col("confidence")[f].alias(f"{f}_confidence") for f in ("invoice_number", "vendor_name", "tax_amount")],
        F.col("source")["tax_amount"].alias("tax_amount_source"),
    )


@query
def lx_compute(spark: SparkSession, folder: str) -> DataFrame:
    """Layout extraction from text alone; tax or subtotal filled where the text lacks them."""
    merged = L.extract_layout(D.texts(spark, folder))
    return merged.select(
        "invoice_id",
        _money("subtotal").alias("subtotal"),
        _money("tax_amount").alias("tax_amount"),
        F.col("source")["subtotal"].alias("subtotal_source"),
        F.col("source")["tax_amount"].alias("tax_amount_source"),
    )


@query
def lx_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Priority merge of a long table of field extractions."""
    invoices = D.invoices(spark, folder)
    key = F.col("invoice_id")

    def entry(field: str, value: Column, confidence: Column, source: str) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            value.alias("value"),
            confidence.cast("double").alias("confidence"),
            F.lit(source).alias("source"),
        )

    layout_confidence = F.when(key % 5 == 0, 60).otherwise(90)
    rows = F.array(
        entry("invoice_number", F.concat(F.lit("R"), key.cast("string")), F.lit(60), "regex"),
        entry("invoice_number", F.concat(F.lit("L"), key.cast("string")), layout_confidence, "layout"),
        entry("invoice_number", F.col("invoice_number"), F.lit(95), "model"),
        entry("currency", F.lit("USD"), F.lit(70), "regex"),
        entry("currency", F.col("currency"), F.lit(95), "model"),
        entry("buyer_name", F.col("buyer_name"), F.lit(80), "layout"),
    )
    return L.merge_by_confidence(invoices.select("invoice_id", F.inline(rows)))


# ---- responses and entities -----------------------------------------------------------------


@query
def l_fences(spark: SparkSession, folder: str) -> DataFrame:
    parsed = R.parse_responses(D.responses(D.invoices(spark, folder)), fences="leading")
    return parsed.select("invoice_id", "parsed", "invoice_number", "vendor_name", _money("total_amount").alias("total_amount"))


@query
def l_fences_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    parsed = R.parse_responses(D.responses(D.invoices(spark, folder)), fences="anywhere")
    return parsed.select("invoice_id", "parsed", "invoice_number", "buyer_name", "invoice_date")


@query
def l_braces(spark: SparkSession, folder: str) -> DataFrame:
    return D.responses(D.invoices(spark, folder)).select("invoice_id", R.braced(F.col("response")).alias("json"))


@query
def l_gst_invoice(spark: SparkSession, folder: str) -> DataFrame:
    parsed = R.gst_flags(R.parse_responses(D.gst_responses(D.invoices(spark, folder)), shape="gst"))
    return parsed.select(
        "invoice_id",
        "parsed",
        "supplier_name",
        "supplier_gst",
        "supplier_gst_ok",
        "customer_name",
        "invoice_number",
        "invoice_date",
        "due_date",
        "total_amount",
        F.get("items", F.lit(0))["description"].alias("item_description"),
        F.get("items", F.lit(0))["amount"].alias("item_amount"),
    )


@query
def l_gst_to_core(spark: SparkSession, folder: str) -> DataFrame:
    gst = R.parse_responses(D.gst_responses(D.invoices(spark, folder)), shape="gst")
    # Both mappings of a row side by side: parsed once, and nothing to join.
    mapped = R.gst_to_invoice(gst.withColumn("gst", F.struct(*gst.columns)), map_parties=True).select(
        F.col("vendor_name").alias("mapped_vendor"), F.size("line_items").alias("mapped_items"), "gst"
    )
    return R.gst_to_invoice(mapped.select("mapped_vendor", "mapped_items", "gst.*")).select(
        "invoice_id", "invoice_number", "vendor_name", F.size("line_items").alias("n_items"), "mapped_vendor", "mapped_items"
    )


@query
def l_entities(spark: SparkSession, folder: str) -> DataFrame:
    wide = R.entities_to_invoice(D.entities(D.invoices(spark, folder)))
    return wide.select(
        "invoice_id", "supplier_name", "customer_name", "invoice_number", "invoice_date", "due_date", "total_amount"
    )


@query
def snk_gst_json(spark: SparkSession, folder: str) -> DataFrame:
    wide = R.entities_to_invoice(D.entities(D.invoices(spark, folder)))
    return R.gst_json(wide).select("invoice_id", "json")


# ---- two-source merge -------------------------------------------------------------------------


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    first = D.invoices(spark, folder)
    return M.merge_sources(first, D.second_source(first), f"{AS_OF}T00:00:00")


@query
def m_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Every comparison where at most one side has a value."""
    compared = M.field_comparisons(_merged(spark, folder))
    one_sided = compared.filter(F.col("selection_reason").rlike("missing$|^Google unavailable|^PDF unavailable"))
    return one_sided.select("invoice_id", "field_name", "selected_value", "selection_reason", "confidence_score", "is_mismatch")


@query
def m_numeric(spark: SparkSession, folder: str) -> DataFrame:
    compared = M.field_comparisons(_merged(spark, folder))
    amounts = compared.filter(F.col("selection_reason").startswith("Google preferred"))
    return amounts.select(
        "invoice_id", "field_name", "pdf_value", "google_value", "confidence_score", "is_mismatch", "recommendation"
    )


@query
def m_items(spark: SparkSession, folder: str) -> DataFrame:
    compared = M.field_comparisons(_merged(spark, folder))
    return compared.filter(F.col("field_name") == "line_items").select(
        "invoice_id", "selected_value", "selection_reason", "confidence_score", "is_mismatch", "recommendation"
    )


@query
def m_text(spark: SparkSession, folder: str) -> DataFrame:
    compared = M.field_comparisons(_merged(spark, folder))
    return compared.filter(F.col("selection_reason").contains("similarity=")).select(
        "invoice_id", "field_name", "selected_value", "selection_reason", "confidence_score", "is_mismatch"
    )


@query
def m_quality(spark: SparkSession, folder: str) -> DataFrame:
    first = D.invoices(spark, folder)
    return M.merge_scores(first, D.second_source(first), f"{AS_OF}T00:00:00").select(
        "invoice_id",
        "mismatch_count",
        "quality_score",
        "recommendation",
        F.col("notes")[0].alias("note"),
        F.col("pdf_source.extracted_fields").alias("pdf_fields"),
        F.col("google_source.extracted_fields").alias("google_fields"),
        F.col("google_source.confidence").alias("google_confidence"),
    )


@query
def m_final(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).select(
        "invoice_id", "invoice_number", "vendor_name", "buyer_name", "due_date", "currency", "subtotal", "item_count"
    )


# ---- routing and documents ----------------------------------------------------------------------


@query
def rt_method(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    requested = (
        F.when(key % 5 == 0, "auto")
        .when(key % 5 == 1, routing.DOCUMENT)
        .when(key % 5 == 2, routing.MODEL)
        .when(key % 5 == 3, routing.LOCAL)
        .otherwise("something")
    )
    ready = (key % 2 == 0, key % 3 == 0)
    return table(spark, folder, "orders").select(
        key.alias("invoice_id"),
        routing.choose_method(requested, *ready).alias("service_method"),
        routing.choose_method(requested, *ready, unknown="auto").alias("batch_method"),
    )


@query
def rt_pick(spark: SparkSession, folder: str) -> DataFrame:
    picked = routing.pick_extraction(D.candidates(D.invoices(spark, folder)))
    return picked.select(
        "invoice_id", "model_used", "confidence", "error", "method", _money("total_amount").alias("total_amount")
    )


@query
def rt_pick_explicit(spark: SparkSession, folder: str) -> DataFrame:
    picked = routing.pick_extraction(D.candidates(D.invoices(spark, folder)), requested=routing.MODEL)
    return picked.select("invoice_id", "model_used", "confidence", "error", "method")


@query
def rt_documents(spark: SparkSession, folder: str) -> DataFrame:
    texts = D.texts(spark, folder).withColumnRenamed("invoice_id", "file_id")
    processed = process_documents(D.files(spark, folder), texts, AS_OF)
    return processed.select(
        "file_id",
        "file_type",
        "success",
        "error",
        "invoice_number",
        "vendor_name",
        "total_amount",
        "is_valid",
        "score",
        F.size("errors").alias("n_errors"),
    )


# ---- streaming --------------------------------------------------------------------------------


@query
def ss_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a stream, each becoming an invoice that is validated and appended to a table."""
    schema = table(spark, folder, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    # Every batch joins the same static side: it is summed up and written once.
    sides = {name: written(side, "sides") for name, side in D.order_sides(spark, folder).items()}
    validated = intake.validate_stream(D.invoices_from_orders(orders, spark, folder, sides), AS_OF)
    rows = validated.select("invoice_id", "invoice_number", "is_valid", "score")
    target = shared_folder(spark, "validated")
    intake.append_available(rows, f"{target}/table", f"{target}/checkpoint")
    return spark.read.parquet(f"{target}/table")


@query
def ss_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads arrive in several files and disturbed order and are stored; repeats within a second do not count."""
    target = shared_folder(spark, "uploads")
    uploads = D.uploads_from_events(table(spark, folder, "events"))
    uploads.repartition(8, F.xxhash64("ts")).write.parquet(f"{target}/arriving")
    arriving = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 3).parquet(f"{target}/arriving")
    intake.append_available(arriving, f"{target}/table", f"{target}/checkpoint")
    accepted = intake.accepted_uploads(spark.read.parquet(f"{target}/table"))
    return accepted.select("file_name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
