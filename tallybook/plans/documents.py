"""The document jobs: check files, extract, validate, and account for every file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators import routing
from tallybook.operators.basic_extract import extract_basic
from tallybook.operators.layout_extract import extract_layout
from tallybook.operators.store import to_store
from tallybook.operators.validate import validate_invoices
from tallybook.schema import INVOICE_FIELDS, INVOICE_TYPE
from tallybook.sources.files import file_type, gate_files, needs_ocr

NOT_EXTRACTABLE = "File type not supported for extraction"


def process_documents(
    files: DataFrame,
    texts: DataFrame,
    as_of: str | dt.date | Column,
    method: str = "basic",
    intake: str = "batch",
    words: DataFrame | None = None,
    responses: DataFrame | None = None,
    key: str = "file_id",
) -> DataFrame:
    """One row per file: the extracted invoice and its validation, or the ``error`` that stopped it.

    ``files`` holds key, ``file_name`` and ``length``; ``texts`` the text per key. A file that
    is accepted but not a PDF succeeds with an empty, invalid invoice. ``method`` is ``basic``
    or ``layout``; the latter may use ``words`` and parsed model ``responses``.
    """
    if method not in ("basic", "layout"):
        raise ValueError(f"unknown method: {method}")
    checked = gate_files(files, intake).withColumn("file_type", file_type(F.col("file_name")))
    readable = F.col("error").isNull() & (F.col("file_type") == "pdf")
    joined = checked.join(texts.select(key, "text"), key, "left").withColumn(
        "text", F.when(readable, F.coalesce("text", F.lit("")))
    )
    if method == "layout":
        extracted = extract_layout(joined, words, responses, key=key)
    else:
        extracted = extract_basic(joined)
    # Only PDF rows that passed the check keep what was read from them.
    fields = [f for f in INVOICE_FIELDS + ["line_items"] if f in extracted.columns]
    extracted = extracted.withColumns({f: F.when(readable, F.col(f)) for f in fields})
    extracted = extracted.withColumn("needs_ocr", F.when(readable, needs_ocr(F.col("text"))))

    return _accounted(extracted, readable, as_of).drop("text")


def _accounted(extracted: DataFrame, readable: Column, as_of: str | dt.date | Column) -> DataFrame:
    """Extracted files with their validation; one that is accepted but not readable has an empty, invalid result."""
    validated = validate_invoices(extracted, as_of)
    accepted = F.col("error").isNull()
    none = F.array().cast("array<string>")
    return validated.withColumns(
        {
            "success": accepted,
            "is_valid": F.when(readable, F.col("is_valid")).when(accepted, False),
            "score": F.when(readable, F.col("score")).when(accepted, 0),
            "errors": F.when(readable, F.col("errors")).when(accepted, F.array(F.lit(NOT_EXTRACTABLE))),
            "warnings": F.when(readable, F.col("warnings")).when(accepted, none),
        }
    )


def process_uploads(
    files: DataFrame,
    texts: DataFrame,
    as_of: str | dt.date | Column,
    document_answers: DataFrame | None = None,
    model_answers: DataFrame | None = None,
    intake: str = "single",
    key: str = "file_id",
) -> DataFrame:
    """One row per uploaded file, each extracted by the method asked for or the next one that works.

    ``files`` holds key, ``file_name``, ``length``, ``requested`` (``auto``, a method, or anything else for the default),
    and whether the services are there for it: ``document_ready``, ``model_ready``. ``texts`` holds the text per
    key; the answers hold the key, ``error`` (null where the service worked) and any invoice columns. Nothing that fails
    stops the job: a failed attempt is a candidate with its message, and the file is read locally in its stead. The
    pattern extraction runs only on texts that no service answered for. ``extraction_error`` says why an emergency
    fallback was taken, ``error`` why a file was not accepted. Keys are expected to be unique.
    """
    checked = gate_files(files, intake).withColumn("file_type", file_type(F.col("file_name")))
    readable = F.col("error").isNull() & (F.col("file_type") == "pdf")
    fields = INVOICE_FIELDS + ["line_items"]
    kinds = {f.name: f.dataType for f in INVOICE_TYPE}
    answers = {routing.DOCUMENT: document_answers, routing.MODEL: model_answers}
    kept = [c for c in checked.columns if c != key]
    about = checked.select(key, "requested", "document_ready", "model_ready", F.struct(*kept).alias("_file"))
    own_text = about.join(texts.select(key, F.col("text").alias("_text")), key, "left")
    is_pdf = F.col("_file.error").isNull() & (F.col("_file.file_type") == "pdf")
    named = routing.attempts(own_text, answers, {f: kinds[f] for f in fields}, key, is_pdf)
    picked = routing.pick_extraction(named, F.col("requested"), key).select(
        key, "model_used", "confidence", F.col("error").alias("extraction_error"), "method", "requested", "_file", "_text",
        F.struct(*fields).alias("_answer"),
    )

    rows = picked.select("*", *[F.col(f"_file.{c}").alias(c) for c in ("file_name", "length", "error", "file_type")])
    by_text = readable & (F.col("method") == routing.LOCAL)
    rows = extract_basic(rows.withColumn("text", F.when(by_text, F.coalesce("_text", F.lit("")))))
    rows = rows.withColumns(
        {f: F.when(by_text, F.col(f)).when(readable, F.col("_answer")[f]) for f in fields}
    )
    return _accounted(rows, readable, as_of).select(
        key, "file_name", "file_type", F.col("requested").alias("method_requested"),
        F.when(readable, F.col("model_used")).when(F.col("error").isNull(), "unknown").alias("model_used"),
        F.when(readable, F.col("confidence")).when(F.col("error").isNull(), 0.0).alias("confidence"),
        F.when(readable, F.col("extraction_error")).alias("extraction_error"),
        *fields, "success", "error", "is_valid", "score", "errors", "warnings",
    )


def upload_records(processed: DataFrame, created_at: str | dt.datetime | Column, key: str = "file_id") -> DataFrame:
    """Processed uploads that were accepted, as stored records with how their extraction came about."""
    accepted = processed.where("success").withColumn("invoice_id", F.col(key)).withColumn("file_id", F.col(key))
    metadata = F.struct(
        F.col("method_requested"), F.col("model_used"), F.col("confidence"), F.col("extraction_error").alias("error")
    )
    return to_store(accepted.withColumn("extraction_metadata", metadata), created_at)


def unsupported_result(files: DataFrame) -> DataFrame:
    """Accepted files that are not PDFs, with their empty, invalid result."""
    kind = file_type(F.col("file_name"))
    return files.filter(kind != "pdf").select(
        *files.columns,
        F.lit(False).alias("is_valid"),
        F.lit(0).alias("score"),
        F.array(F.lit(NOT_EXTRACTABLE)).alias("errors"),
        F.array().cast("array<string>").alias("warnings"),
    )
