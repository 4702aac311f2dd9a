"""Invoice extraction, reconciliation and quality control as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from tallybook.functions.normalize import (
    normalize_amount,
    normalize_date,
    normalize_gst,
    normalize_text,
)
from tallybook.operators.basic_extract import extract_basic
from tallybook.operators.layout_extract import extract_layout, merge_by_confidence, to_wide
from tallybook.operators.reconcile import field_comparisons, merge_scores, merge_sources
from tallybook.operators.responses import entities_to_invoice, gst_json, gst_to_invoice, parse_responses
from tallybook.operators.routing import choose_method, pick_extraction
from tallybook.operators.stats import (
    batch_errors,
    batch_results,
    batch_summary,
    completeness,
    dashboard_stats,
    error_counts,
    load_summary,
    validation_summary,
    verification_stats,
)
from tallybook.operators.store import (
    FileStore,
    delete_invoices,
    file_lookup,
    get_invoice,
    index_pages,
    list_page,
    next_page,
    page_envelope,
    to_file_store,
    to_store,
)
from tallybook.operators.validate import rule_hits, score_band, validate_invoices
from tallybook.operators.verify import recommend, verify, verify_and_validate, verify_fields
from tallybook.operators.views import (
    list_view,
    result_view,
    to_field_value,
    write_field_value_csv,
    write_results_json,
)
from tallybook.plans.documents import process_documents, process_uploads, unsupported_result, upload_records
from tallybook.sources.files import (
    assemble_text,
    file_type,
    gate_files,
    needs_ocr,
    read_invoice_files,
)
from tallybook.sources.invoice_json import load_invoices, read_invoice_json
from tallybook.sources.json_arrays import read_json_records
from tallybook.streaming.intake import (
    accepted_uploads,
    append_available,
    append_summaries,
    json_stream,
    summed_dashboard,
    summed_error_counts,
    suppress_duplicates,
    validate_stream,
)

# Arrow UDFs travel to executors by value, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "FileStore",
    "accepted_uploads",
    "append_available",
    "append_summaries",
    "assemble_text",
    "batch_errors",
    "batch_results",
    "batch_summary",
    "choose_method",
    "completeness",
    "dashboard_stats",
    "delete_invoices",
    "entities_to_invoice",
    "error_counts",
    "extract_basic",
    "extract_layout",
    "field_comparisons",
    "file_lookup",
    "file_type",
    "gate_files",
    "get_invoice",
    "gst_json",
    "gst_to_invoice",
    "index_pages",
    "json_stream",
    "list_page",
    "list_view",
    "load_invoices",
    "load_summary",
    "merge_by_confidence",
    "merge_scores",
    "merge_sources",
    "needs_ocr",
    "next_page",
    "normalize_amount",
    "normalize_date",
    "normalize_gst",
    "normalize_text",
    "page_envelope",
    "parse_responses",
    "pick_extraction",
    "process_documents",
    "process_uploads",
    "read_invoice_files",
    "read_invoice_json",
    "read_json_records",
    "recommend",
    "result_view",
    "rule_hits",
    "score_band",
    "summed_dashboard",
    "summed_error_counts",
    "suppress_duplicates",
    "to_field_value",
    "to_file_store",
    "to_store",
    "to_wide",
    "unsupported_result",
    "upload_records",
    "validate_invoices",
    "validate_stream",
    "validation_summary",
    "verification_stats",
    "verify",
    "verify_and_validate",
    "verify_fields",
    "write_field_value_csv",
    "write_results_json",
]
