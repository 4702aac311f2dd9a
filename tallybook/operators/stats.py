"""Summaries over validated, verified and processed invoices.

Each is one partial and one final hash aggregate; nothing is collected per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rounded(total: Column, count: Column, places: int) -> Column:
    return F.when(count > 0, F.round(total / count, places)).otherwise(F.lit(0).cast("decimal(18,2)"))


def dashboard_partials(df: DataFrame) -> DataFrame:
    """One row of exact sums and counts over some invoices, which add up with those over others."""
    amount = F.col("total_amount").try_cast("decimal(38,10)")
    unsummed = F.col("total_amount").isNotNull() & amount.isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_valid")).alias("valid"),
        F.try_sum(amount).alias("amount"),
        F.count(amount).alias("amounts"),
        F.count_if(unsummed).alias("unsummed"),
        F.coalesce(F.sum(F.coalesce(F.col("score"), F.lit(0))), F.lit(0)).cast("long").alias("score"),
    )


def fold_dashboard(partials: DataFrame) -> DataFrame:
    """The dashboard from any number of partial rows: the same as from all their invoices at once."""
    # A partial sum that is null though there are amounts has overflowed, and so has the whole.
    overflowed = F.bool_or((F.col("amounts") > 0) & F.col("amount").isNull())
    total = F.when(F.coalesce(overflowed, F.lit(False)), F.lit(None)).otherwise(
        F.coalesce(F.try_sum("amount"), F.when(F.coalesce(F.sum("amounts"), F.lit(0)) == 0, F.lit(0)))
    )
    sums = partials.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "valid", "unsummed", "score")], total.alias("amount")
    )
    return sums.select(
        F.col("n").alias("total_invoices"),
        F.col("valid").alias("valid_invoices"),
        (F.col("n") - F.col("valid")).alias("invalid_invoices"),
        F.round("amount", 2).cast("double").alias("total_amount"),
        _rounded(F.col("score").cast("decimal(18,0)"), F.col("n").cast("decimal(18,0)"), 2)
        .cast("double")
        .alias("average_validation_score"),
        F.col("unsummed").alias("unsummed_amounts"),
    )


def dashboard_stats(df: DataFrame) -> DataFrame:
    """One row: totals, valid and invalid counts, amount sum and mean score. Empty gives zeros.

    Amounts are summed as wide decimals and rounded once, so the result does not depend on how rows are
    distributed. Amounts that have no such decimal (not finite, or 28 digits before the point and more) are
    counted in ``unsummed_amounts``.
    """
    return fold_dashboard(dashboard_partials(df))


def fold_error_counts(partials: DataFrame) -> DataFrame:
    """Error counts from those of parts."""
    return partials.groupBy("error").agg(F.sum("n").alias("n"))


def validation_summary(df: DataFrame) -> DataFrame:
    """One row: total, valid and invalid invoices."""
    return df.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("is_valid")).alias("valid_invoices"),
        F.count_if(~F.coalesce(F.col("is_valid"), F.lit(False))).alias("invalid_invoices"),
    )


def error_counts(df: DataFrame) -> DataFrame:
    """How often each error message occurs."""
    # The outer form keeps the planner from evaluating the list a second time as a filter.
    errors = df.select(F.explode_outer("errors").alias("error")).filter(F.col("error").isNotNull())
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def load_summary(df: DataFrame) -> DataFrame:
    """One row: valid invoices out of all records, unreadable records included in the total."""
    return df.agg(
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("load_error").isNotNull()).alias("unreadable"),
    )


def verification_stats(df: DataFrame) -> DataFrame:
    """One row: counts per verification status, corrections, and mean confidence."""
    status = F.col("status")
    return df.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(status == "Verified").alias("verified"),
        F.count_if(status == "Review Needed").alias("review_needed"),
        F.count_if(status == "High Confidence").alias("high_confidence"),
        F.count_if(~status.isin("Verified", "Review Needed", "High Confidence")).alias("low_confidence"),
        F.coalesce(F.sum(F.size("corrections")), F.lit(0)).cast("bigint").alias("total_corrections"),
        F.coalesce(F.avg("overall_confidence"), F.lit(0.0)).alias("average_confidence"),
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """One row for a processed batch: files, successes, failures, and success rate in percent."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success")).alias("ok"))
    rate = F.col("ok").cast("decimal(18,0)") * 100 / F.col("n").cast("decimal(18,0)")
    return counts.select(
        F.col("n").alias("total_files"),
        F.col("ok").alias("successful"),
        (F.col("n") - F.col("ok")).alias("failed"),
        F.when(F.col("n") > 0, F.round(rate, 1).cast("double")).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def batch_results(df: DataFrame) -> DataFrame:
    """The successful rows of a processed batch."""
    return df.filter(F.col("success"))


def batch_errors(df: DataFrame) -> DataFrame:
    """File name and error of the failed rows of a processed batch."""
    return df.filter(~F.col("success")).select("file_name", "error")


def completeness(df: DataFrame) -> DataFrame:
    """Add ``extracted_fields``, ``source_confidence`` and ``is_complete``.

    Counts eight fields that are neither null nor empty; an empty item list counts as present.
    """
    present = extracted_fields(lambda name: F.col(name), "line_items" in df.columns)
    return df.withColumn("extracted_fields", present).withColumns(
        {
            "source_confidence": F.when(F.col("extracted_fields") >= 6, 85.0).otherwise(60.0),
            "is_complete": F.col("extracted_fields") >= 8,
        }
    )


def extracted_fields(field, nested_items: bool) -> Column:
    """Number of present fields; ``field`` maps a field name to its column."""
    texts = ["invoice_number", "vendor_name", "buyer_name", "invoice_date", "due_date", "currency"]
    count = F.lit(0)
    for name in texts:
        count = count + F.when(field(name) != "", 1).otherwise(0)
    count = count + F.when(field("total_amount").isNotNull(), 1).otherwise(0)
    items = field("line_items" if nested_items else "item_count")
    return count + F.when(items.isNotNull(), 1).otherwise(0)
