"""The invoice rule set: completeness, formats, business logic, anomalies, and the score.

Validation is a narrow projection. Every rule becomes one boolean column, computed once; the
score, the message lists and the long form are derived from those columns, so a query that
needs only the score never builds a message.

Fixed values: the messages of the rules below are stated as results must have them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import patterns as P
from tallybook.functions.dates import whole_days, with_parsed_date
from tallybook.functions.pycompat import (
    exceeds,
    falsy_number,
    falsy_text,
    py_float_text,
    truthy_number,
    truthy_text,
)

ERROR, WARNING = "error", "warning"
TOLERANCE = 0.01


@dataclass(frozen=True)
class Rule:
    """One check: when ``hit`` holds, ``penalty`` points are lost and ``message`` is reported."""

    rule: str
    severity: str
    penalty: int
    hit: Column
    message: Column

    @property
    def flag(self) -> str:
        return f"_hit_{self.rule}"


def _missing(rule: str, severity: str, penalty: int, falsy: Column, label: str) -> Rule:
    kind = "required" if severity == ERROR else "important"
    return Rule(rule, severity, penalty, falsy, F.lit(f"Missing {kind} field: {label}"))


def _items_total(df: DataFrame) -> Column | None:
    """Sum of the item totals: from the nested items, or from a pre-aggregated column."""
    if "line_items" in df.columns:
        return F.aggregate(
            F.col("line_items"),
            F.lit(0.0),
            lambda total, item: total + F.coalesce(item["total"], F.lit(0.0)),
        )
    if "items_total" in df.columns:
        return F.col("items_total")
    return None


def _rules(df: DataFrame, documented_high_amount: bool, min_confidence: float | None) -> list[Rule]:
    number, vendor, buyer = F.col("invoice_number"), F.col("vendor_name"), F.col("buyer_name")
    currency = F.col("currency")
    subtotal, tax, total = F.col("subtotal"), F.col("tax_amount"), F.col("total_amount")
    invoiced, due, today = F.col("_invoice_date"), F.col("_due_date"), F.col("_as_of")

    comparable = invoiced["zoned"] == due["zoned"]
    due_first = (due["day"] < invoiced["day"]) | ((due["day"] == invoiced["day"]) & (due["tod"] < invoiced["tod"]))
    term = whole_days(due["day"], due["tod"], invoiced["day"], invoiced["tod"])
    age = whole_days(today, F.lit(0).cast("bigint"), invoiced["day"], invoiced["tod"])
    datable = ~invoiced["zoned"]
    amounts = truthy_number(subtotal) & truthy_number(tax) & truthy_number(total)

    rules = [
        _missing("V01", ERROR, 15, falsy_text(number), "Invoice Number"),
        _missing("V02", ERROR, 15, falsy_text(vendor), "Vendor Name"),
        _missing("V03", ERROR, 15, falsy_number(total), "Total Amount"),
        _missing("V04", ERROR, 15, falsy_text(F.col("invoice_date")), "Invoice Date"),
        _missing("V05", WARNING, 5, falsy_text(buyer), "Buyer Name"),
        _missing("V06", WARNING, 5, falsy_text(currency), "Currency"),
        _missing("V07", WARNING, 5, falsy_text(F.col("due_date")), "Due Date"),
        Rule("V08", ERROR, 10, F.length(number).between(1, 2), F.lit("Invoice number is too short (minimum 3 characters)")),
        Rule(
            "V09",
            ERROR,
            10,
            truthy_text(F.col("invoice_date")) & invoiced["day"].isNull(),
            F.concat(F.lit("Invalid invoice date format: "), F.col("invoice_date")),
        ),
        Rule(
            "V10",
            ERROR,
            10,
            truthy_text(F.col("due_date")) & due["day"].isNull(),
            F.concat(F.lit("Invalid due date format: "), F.col("due_date")),
        ),
        Rule("V11", ERROR, 15, total < 0, F.lit("Total amount cannot be negative")),
        Rule("V12", WARNING, 5, total == 0, F.lit("Total amount is zero")),
        Rule(
            "V13",
            WARNING,
            3,
            truthy_text(currency) & ~currency.isin(P.COMMON_CURRENCIES),
            F.concat(F.lit("Uncommon currency code: "), currency),
        ),
        Rule("V14", ERROR, 15, comparable & due_first, F.lit("Due date cannot be before invoice date")),
        Rule(
            "V15",
            WARNING,
            5,
            comparable & (term > 365),
            F.concat(F.lit("Unusually long payment term: "), term.cast("string"), F.lit(" days")),
        ),
        Rule(
            "V16",
            ERROR,
            20,
            amounts & exceeds(F.abs(subtotal + tax - total), TOLERANCE),
            F.concat(
                F.lit("Amount mismatch: Subtotal ("),
                py_float_text(subtotal),
                F.lit(") + Tax ("),
                py_float_text(tax),
                F.lit(") does not equal Total ("),
                py_float_text(total),
                F.lit(")"),
            ),
        ),
    ]

    items_total = _items_total(df)
    if items_total is not None:
        rules.append(
            Rule(
                "V17",
                WARNING,
                5,
                truthy_number(subtotal)
                & exceeds(items_total, 0)
                & exceeds(F.abs(items_total - subtotal), TOLERANCE),
                F.concat(
                    F.lit("Line items total ("),
                    py_float_text(items_total),
                    F.lit(") does not match subtotal ("),
                    py_float_text(subtotal),
                    F.lit(")"),
                ),
            )
        )

    suspicious = exceeds(total, 10_000_000) if documented_high_amount else F.lit(False)
    rules += [
        Rule(
            "V18",
            WARNING,
            3,
            exceeds(total, 1_000_000) & ~suspicious,
            F.concat(F.lit("Unusually high amount: "), py_float_text(total)),
        ),
        Rule("V19", ERROR, 10, suspicious, F.concat(F.lit("Suspiciously high amount: "), py_float_text(total))),
        Rule(
            "V20",
            WARNING,
            5,
            truthy_text(vendor) & truthy_text(buyer) & (F.lower(vendor) == F.lower(buyer)),
            F.lit("Vendor and buyer names are identical"),
        ),
        Rule(
            "V21",
            WARNING,
            5,
            datable & (age < -30),
            F.concat(F.lit("Invoice date is "), F.abs(age).cast("string"), F.lit(" days in the future")),
        ),
        Rule(
            "V22",
            WARNING,
            3,
            datable & (age > 730),
            F.concat(F.lit("Invoice is "), age.cast("string"), F.lit(" days old")),
        ),
    ]
    if min_confidence is not None:
        rules.append(
            Rule(
                "low_confidence",
                WARNING,
                0,
                F.col("confidence") < F.lit(float(min_confidence)),
                F.concat(F.lit("Extraction confidence is low: "), py_float_text(F.col("confidence").cast("double"))),
            )
        )
    return rules


def _as_column(as_of: str | dt.date | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def _with_hits(
    df: DataFrame,
    as_of: str | dt.date | Column,
    documented_high_amount: bool,
    min_confidence: float | None,
    unusual_dates: bool,
) -> tuple[DataFrame, list[Rule]]:
    today = F.col("_as_of")
    dated = df.withColumn("_as_of", _as_column(as_of))
    dated = with_parsed_date(dated, "_invoice_date", "invoice_date", today, unusual_dates)
    dated = with_parsed_date(dated, "_due_date", "due_date", today, unusual_dates)
    rules = _rules(df, documented_high_amount, min_confidence)
    hits = {r.flag: F.coalesce(r.hit, F.lit(False)) for r in rules}
    return dated.withColumns(hits), rules


def validate_invoices(
    df: DataFrame,
    as_of: str | dt.date | Column,
    documented_high_amount: bool = False,
    min_confidence: float | None = None,
    unusual_dates: bool = True,
) -> DataFrame:
    """Add ``is_valid``, ``score``, ``errors`` and ``warnings`` to every invoice row.

    An invoice is valid when it has no errors, whatever its score. Items come as a nested
    ``line_items`` array, as a pre-aggregated ``items_total`` column, or not at all.

    ``documented_high_amount`` makes totals above ten million an error of their own.
    ``min_confidence`` adds a warning (no points) below that extraction ``confidence``.
    ``unusual_dates=False`` reads dates by the native forms only, without the Arrow UDF.
    """
    flagged, rules = _with_hits(df, as_of, documented_high_amount, min_confidence, unusual_dates)

    def messages(severity: str) -> Column:
        found = [F.when(F.col(r.flag), r.message) for r in rules if r.severity == severity]
        return F.array_compact(F.array(*found))

    has_error = F.lit(False)
    lost = F.lit(0)
    for r in rules:
        lost = lost + F.when(F.col(r.flag), r.penalty).otherwise(0)
        if r.severity == ERROR:
            has_error = has_error | F.col(r.flag)
    return flagged.select(
        *[F.col(c) for c in df.columns],
        (~has_error).alias("is_valid"),
        F.greatest(F.lit(0), F.lit(100) - lost).alias("score"),
        messages(ERROR).alias("errors"),
        messages(WARNING).alias("warnings"),
    )


def rule_hits(
    df: DataFrame,
    as_of: str | dt.date | Column,
    key: str = "invoice_id",
    documented_high_amount: bool = False,
    min_confidence: float | None = None,
    unusual_dates: bool = True,
) -> DataFrame:
    """One row per rule that an invoice breaks: key, rule, severity, penalty, message."""
    flagged, rules = _with_hits(df, as_of, documented_high_amount, min_confidence, unusual_dates)
    hits = [
        F.when(
            F.col(r.flag),
            F.struct(
                F.lit(r.rule).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.penalty).alias("penalty"),
                r.message.alias("message"),
            ),
        )
        for r in rules
    ]
    # The outer form keeps the planner from evaluating all rules a second time as a filter.
    rows = flagged.select(key, F.inline_outer(F.array_compact(F.array(*hits))))
    return rows.filter(F.col("rule").isNotNull())


def score_band(score: Column) -> Column:
    """``high`` from 80, ``medium`` from 60, else ``low``."""
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")
