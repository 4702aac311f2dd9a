"""Verification of critical fields and the recommendation drawn from both results.

Fixed values: the texts of statuses, notes and recommendations below are stated as results must have them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.pycompat import falsy_number, falsy_text, py_float_text, truthy_text
from tallybook.operators.validate import validate_invoices

CORRECTION_TYPE = (
    "array<struct<field_name:string,original_value:string,corrected_value:string,confidence:double,"
    "source:string,reasoning:string,source_url:string,requires_review:boolean>>"
)


def verify(df: DataFrame) -> DataFrame:
    """Add the verification columns: critical issues, status, confidence and summary."""
    critical = F.array_compact(
        F.array(
            F.when(falsy_text(F.col("invoice_number")), "Missing invoice number"),
            F.when(falsy_text(F.col("vendor_name")), "Missing vendor name"),
            F.when(falsy_number(F.col("total_amount")), "Missing total amount"),
        )
    )
    complete = ~(
        falsy_text(F.col("invoice_number")) | falsy_text(F.col("vendor_name")) | falsy_number(F.col("total_amount"))
    )
    number = F.when(truthy_text(F.col("invoice_number")), F.col("invoice_number")).otherwise("N/A")
    return df.withColumns(
        {
            "verified_number": number,
            "critical_issues": critical,
            "corrections": F.array().cast(CORRECTION_TYPE),
            "status": F.when(complete, "Verified").otherwise("Review Needed"),
            "overall_confidence": F.when(complete, 95.0).otherwise(50.0),
        }
    ).withColumn("summary", F.concat(F.lit("Verification complete. Status: "), F.col("status")))


def _unchanged(value: Column, field: str, confidence: float) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"),
        value.alias("original_value"),
        value.alias("corrected_value"),
        F.lit(confidence).alias("confidence"),
        F.lit("stub").alias("source"),
        F.lit("Stub verification - no changes made").alias("reasoning"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(False).alias("requires_review"),
    )


def verify_fields(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """One row per verified field. Values are never changed; the confidence is fixed per kind."""
    checks = [_unchanged(F.col("vendor_name"), "vendor_name", 80.0)]
    checks += [_unchanged(py_float_text(F.col(f)), f, 90.0) for f in ("subtotal", "tax_amount", "total_amount")]
    checks += [_unchanged(F.col(f), f, 85.0) for f in ("invoice_date", "due_date")]
    return df.select(key, F.inline(F.array(*checks)))


def recommend(df: DataFrame) -> DataFrame:
    """Add ``requires_review``, ``required_actions``, ``approval_ready``, ``confidence_level``.

    Needs the columns of ``validate_invoices`` and ``verify``.
    """
    needs_review = F.col("status") == "Review Needed"
    actions = F.transform(
        F.filter(F.col("corrections"), lambda c: c["requires_review"]),
        lambda c: F.concat(
            F.lit("Review correction for "),
            c["field_name"],
            F.lit(": "),
            c["original_value"],
            F.lit(" → "),
            c["corrected_value"],
        ),
    )
    confidence = F.col("overall_confidence")
    reviewed = df.withColumns(
        {
            "requires_review": (F.size("errors") > 0) | needs_review,
            "required_actions": F.when(needs_review, F.concat(F.col("errors"), actions)).otherwise(F.col("errors")),
        }
    )
    return reviewed.withColumns(
        {
            "approval_ready": (confidence >= 90) & ~F.col("requires_review"),
            "confidence_level": F.when((confidence >= 90) & ~F.col("requires_review"), "Very High")
            .when(confidence >= 80, "High")
            .when(confidence >= 70, "Medium")
            .otherwise("Low"),
        }
    )


def verify_and_validate(df: DataFrame, as_of: str | dt.date | Column, **options) -> DataFrame:
    """Validation, verification and recommendation in one row per invoice."""
    return recommend(verify(validate_invoices(df, as_of, **options)))
