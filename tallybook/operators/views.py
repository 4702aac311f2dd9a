"""Shapes for display and export: list rows, result rows, and the field-value form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.pycompat import js_two_decimals, py_float_text, truthy_number, truthy_text
from tallybook.schema import INVOICE_FIELDS

# Exported fields in order, with their labels.
EXPORT_FIELDS = [
    ("Invoice Number", "invoice_number"),
    ("Vendor Name", "vendor_name"),
    ("Buyer Name", "buyer_name"),
    ("Invoice Date", "invoice_date"),
    ("Due Date", "due_date"),
    ("Currency", "currency"),
    ("Subtotal", "subtotal"),
    ("Tax Amount", "tax_amount"),
    ("Total Amount", "total_amount"),
    ("Payment Terms", "payment_terms"),
]


def list_view(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Stored invoices as display rows."""

    def or_dash(name: str) -> Column:
        return F.when(truthy_text(F.col(name)), F.col(name)).otherwise("-").alias(name)

    currency = F.when(truthy_text(F.col("currency")), F.col("currency")).otherwise("USD")
    amount = F.coalesce(js_two_decimals(F.col("total_amount")), F.lit("0.00"))
    return df.select(
        key,
        *[or_dash(n) for n in ("invoice_number", "vendor_name", "buyer_name", "invoice_date")],
        F.concat_ws(" ", currency, amount).alias("amount"),
        F.when(F.col("is_valid"), "Valid").otherwise("Invalid").alias("status"),
        F.coalesce("validation_score", F.lit(0)).alias("score"),
    )


def result_view(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Stored invoices back in the shape of a validation result; null lists become empty."""
    none = F.array().cast("array<string>")
    items = [F.coalesce("line_items", F.expr("array()")).alias("line_items")] if "line_items" in df.columns else []
    return df.select(
        key,
        "invoice_number",
        "is_valid",
        F.col("validation_score").alias("score"),
        F.coalesce("validation_errors", none).alias("errors"),
        F.coalesce("validation_warnings", none).alias("warnings"),
        F.struct(*INVOICE_FIELDS, *items).alias("extracted_data"),
    )


def script_number(c: Column) -> Column:
    """A number the way a browser prints it: no trailing ``.0``."""
    return F.regexp_replace(py_float_text(c), r"\.0$", "")


def to_field_value(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Ten rows per invoice: key, position, field label, and value; no value gives empty text."""

    def value(name: str) -> Column:
        c = F.col(name)
        if name in ("subtotal", "tax_amount", "total_amount"):
            return F.when(truthy_number(c) & ~F.isnan(c), script_number(c)).otherwise("")
        return F.coalesce(c, F.lit(""))

    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("field"), value(name).alias("value"))
            for i, (label, name) in enumerate(EXPORT_FIELDS, 1)
        ]
    )
    return df.select(key, F.inline(rows))


def write_field_value_csv(df: DataFrame, path: str, key: str = "invoice_id", by_invoice: bool = False) -> None:
    """Write the field-value form as CSV, values quoted and quotes inside them escaped.

    Key and position stay, so that every line tells its invoice and lines can be put in order. ``by_invoice`` writes one
    file an invoice instead, in a folder of its key, with the two columns and lines in order. Nothing is visible before
    the whole job is committed.
    """
    lines = [F.col("field").alias("Field"), F.col("value").alias("Value")]
    if by_invoice:
        rows = df.select(key, "position", *lines).repartition(key).sortWithinPartitions(key, "position")
        writer = rows.drop("position").write.partitionBy(key)
    else:
        writer = df.select(key, "position", *lines).write
    writer.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')


def write_results_json(df: DataFrame, path: str, arrays: bool = False) -> None:
    """Write result rows as JSON lines, failed extractions left out.

    ``arrays`` writes each file as one JSON array, a record a line; a task without rows writes no array. Files
    become visible together, when the job is committed.
    """
    kept = df.filter(F.col("error").isNull()) if "error" in df.columns else df
    if not arrays:
        kept.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
        return
    record = F.to_json(F.struct(*kept.columns), {"ignoreNullFields": "false"}).alias("value")
    kept.select(record).mapInArrow(_as_array, "value string").write.mode("errorifexists").text(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a task as lines of one JSON array."""
    lead, held = "[", None
    for batch in batches:
        lines = []
        for record in batch["value"].to_pylist():
            if held is not None:
                lines.append(f"{lead}{held},")
                lead = ""
            held = record
        yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
    if held is not None:
        yield pa.record_batch([pa.array([f"{lead}{held}]"])], ["value"])
