"""Extraction with a confidence per field: model values, word boxes, patterns, and fallbacks.

Each field travels as a value column and a source column; a null source means not found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions import patterns as P
from tallybook.functions.normalize import currency_layout, parse_amount_normalized, to_layout_date
from tallybook.functions.pycompat import (
    FIRST_LINE,
    capture,
    contains_any,
    first_capture,
    fold,
    let,
    line_after,
    pystrip,
    regex,
    truthy_number,
    truthy_text,
)
from tallybook.operators.basic_extract import first_usable
from tallybook.schema import AMOUNT_FIELDS, INVOICE_FIELDS

# Confidence per source and, for captures, per field.
MODEL_CONFIDENCE = 95.0
COMPUTED_CONFIDENCE = 80.0
HEURISTIC_CONFIDENCE = 50.0
CAPTURE_CONFIDENCE = {
    "layout": {
        "vendor_name": 85.0,
        "buyer_name": 80.0,
        "invoice_number": 90.0,
        "invoice_date": 85.0,
        "due_date": 85.0,
        "total_amount": 90.0,
        "subtotal": 85.0,
        "tax_amount": 85.0,
    },
    "regex": {"invoice_number": 60.0, "currency": 70.0},
}
TOP_OF_PAGE = 150.0
FIRST_WORDS = 10


def vendor_from_words(words: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The vendor per document: the first usable word among the first ten at the top of page 0.

    Columns of ``words``: key, ord (reading order), page, text, y0. The row-number limit is
    applied before the shuffle as well, so each map task sends at most ten words per document.
    """
    top = words.filter((F.col("page") == 0) & (F.col("y0") < TOP_OF_PAGE)).select(key, "ord", "text")
    first = top.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(
        F.col("rank") <= FIRST_WORDS
    )
    word = pystrip(F.col("text"))
    usable = (F.length(word) > 3) & ~contains_any(F.lower(word), P.LAYOUT_VENDOR_STOP_WORDS)
    return first.filter(usable).groupBy(key).agg(F.min_by(word, F.col("ord")).alias("vendor_word"))


def buyer_layout(text: Column, folded: Column | None = None) -> Column:
    """Line after a buyer label; else the line after the first ``To:``, ``An:`` or ``Customer:``."""
    labelled = [line_after(re.escape(label)) for label in P.LAYOUT_BUYER_LABELS]
    # The first line feed after the mark is found by itself, and the text is read from there.
    marked = [
        F.when(text.contains(mark), let(F.substr(text, F.instr(text, mark)), _after_line_feed)) for mark in P.LAYOUT_BUYER_MARKS
    ]
    return pystrip(F.coalesce(first_capture(text, labelled, folded=folded), *marked))


def _after_line_feed(text: Column) -> Column:
    rest = F.when(text.contains("\n"), F.substr(text, F.instr(text, "\n")))
    return capture(rest, r"\A\n" + FIRST_LINE)


def number_layout(text: Column, folded: Column | None = None) -> Column:
    """The first pattern whose capture has at least three characters."""
    found = [
        let(capture(text, p, folded=folded), lambda n: F.when(F.length(n) >= 3, pystrip(n))) for p in P.LAYOUT_INVOICE_NUMBER
    ]
    return F.coalesce(*found)


def date_layout(text: Column, labels: list[str], folded: Column | None = None) -> Column:
    """ISO date from the line of the first label that occurs; other labels are not tried."""
    return let(pystrip(first_capture(text, labels, folded=folded)), to_layout_date)


def amount_layout(text: Column, patterns: list[str], folded: Column | None = None) -> Column:
    return F.coalesce(*[let(capture(text, p, folded=folded), parse_amount_normalized) for p in patterns])


def fallback_vendor(text: Column) -> Column:
    return first_usable(F.split(text, "\n", 11), 4, None, P.FALLBACK_VENDOR_STOP_WORDS)


def fallback_buyer(text: Column) -> Column:
    """The text before the first street address on its line, if longer than three characters.

    The address is found first and the line is cut before it: a pattern for both would start anew at every
    character of a line without an address.
    """
    address = F.regexp_substr(text, F.lit(regex(P.FALLBACK_STREET)))
    before = F.substring_index(F.substring(text, F.lit(1), F.instr(text, address) - 1), "\n", -1)
    return let(pystrip(before), lambda s: F.when(F.length(s) > 3, s))


def _has_value(value: Column, amount: bool) -> Column:
    return truthy_number(value) if amount else truthy_text(value)


def layout_captures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the raw captures as ``_layout_*`` and ``_regex_*`` columns, before they are merged."""
    body, folded = F.col(text), F.col("_folded")
    return df.withColumn("_folded", fold(body)).withColumns(
        {
            "_layout_buyer_name": buyer_layout(body, folded),
            "_layout_invoice_number": number_layout(body, folded),
            "_layout_invoice_date": date_layout(body, P.LAYOUT_INVOICE_DATE_LINE, folded),
            "_layout_due_date": date_layout(body, P.LAYOUT_DUE_DATE_LINE, folded),
            "_layout_total_amount": amount_layout(body, P.LAYOUT_TOTAL, folded),
            "_layout_subtotal": amount_layout(body, P.LAYOUT_SUBTOTAL, folded),
            "_layout_tax_amount": amount_layout(body, P.LAYOUT_TAX, folded),
            "_regex_invoice_number": capture(body, P.PLAIN_NUMBER, ignore_case=False, folded=folded),
            "_regex_currency": currency_layout(body),
        }
    )


def _confidence(field: str, source: Column) -> Column:
    """The confidence of a field follows from where its value came from."""
    known = {"model": MODEL_CONFIDENCE, "heuristic": HEURISTIC_CONFIDENCE, "computed": COMPUTED_CONFIDENCE}
    known |= {name: table[field] for name, table in CAPTURE_CONFIDENCE.items() if field in table}
    result = None
    for name, value in known.items():
        result = F.when(source == name, value) if result is None else result.when(source == name, value)
    return result


def _merge_captures(df: DataFrame, modelled: list[str]) -> DataFrame:
    """Add value and source per field: the model if it has one, else the most confident capture."""
    sources, values = {}, {}
    for field in INVOICE_FIELDS:
        is_amount = field in AMOUNT_FIELDS
        captures = [name for name in CAPTURE_CONFIDENCE if f"_{name}_{field}" in df.columns]
        # Layout goes ahead only with strictly more confidence, so ties stay with the pattern.
        captures.sort(key=lambda name: (-CAPTURE_CONFIDENCE[name][field], name != "regex"))
        source = F.when(F.col(f"_model_{field}").isNotNull(), "model") if field in modelled else None
        for name in captures:
            present = _has_value(F.col(f"_{name}_{field}"), is_amount)
            source = F.when(present, name) if source is None else source.when(present, name)
        sources[f"_source_{field}"] = F.lit(None).cast("string") if source is None else source

        value = F.lit(None).cast("double" if is_amount else "string")
        for name in captures + (["model"] if field in modelled else []):
            value = F.when(F.col(f"_source_{field}") == name, F.col(f"_{name}_{field}")).otherwise(value)
        values[f"_value_{field}"] = value
    return df.withColumns(sources).withColumns(values)


def _fill(df: DataFrame, field: str, found: Column, source: str) -> DataFrame:
    """Where ``found`` is not null, it becomes the value of the field."""
    filled = f"_{source}_{field}"
    hit = F.col(filled).isNotNull()
    return df.withColumn(filled, found).withColumns(
        {
            f"_value_{field}": F.when(hit, F.col(filled)).otherwise(F.col(f"_value_{field}")),
            f"_source_{field}": F.when(hit, source).otherwise(F.col(f"_source_{field}")),
        }
    )


def apply_fallbacks(df: DataFrame, text: str = "text") -> DataFrame:
    """Vendor and buyer from the first lines and the first address, where nothing else gave them."""
    for field, fallback in (("vendor_name", fallback_vendor), ("buyer_name", fallback_buyer)):
        missing = ~_has_value(F.col(f"_value_{field}"), False)
        df = _fill(df, field, F.when(missing, fallback(F.col(text))), "heuristic")
    return df


def compute_missing(df: DataFrame) -> DataFrame:
    """Fill tax from total and subtotal, then subtotal from total and tax (the tax just filled)."""
    total, subtotal, tax = (F.col(f"_value_{f}") for f in ("total_amount", "subtotal", "tax_amount"))
    rest = total - subtotal
    plausible = F.abs(rest) < total * 0.5
    given = truthy_number(total) & truthy_number(subtotal)
    df = _fill(df, "tax_amount", F.when(~truthy_number(tax) & given & plausible, rest), "computed")
    net = total - tax
    given = truthy_number(total) & truthy_number(tax)
    return _fill(df, "subtotal", F.when(~truthy_number(subtotal) & given & (net > 0), net), "computed")


def extract_layout(
    text_df: DataFrame,
    words_df: DataFrame | None = None,
    model_df: DataFrame | None = None,
    key: str = "invoice_id",
    text: str = "text",
) -> DataFrame:
    """Invoice columns plus ``confidence`` and ``source`` maps, one row per document.

    ``words_df`` holds word boxes, ``model_df`` already parsed model answers with one row per
    document and any of the invoice columns. Both are optional.
    """
    df = layout_captures(text_df, text)
    if words_df is not None:
        vendors = vendor_from_words(words_df, key).withColumnRenamed("vendor_word", "_layout_vendor_name")
        df = df.join(vendors, key, "left")
    modelled: list[str] = []
    if model_df is not None:
        modelled = [f for f in INVOICE_FIELDS + ["line_items"] if f in model_df.columns]
        df = df.join(model_df.select(key, *[F.col(f).alias(f"_model_{f}") for f in modelled]), key, "left")

    df = compute_missing(apply_fallbacks(_merge_captures(df, modelled), text))

    def known(entry) -> Column:
        pairs = [
            F.when(F.col(f"_source_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), entry(f).alias("entry")))
            for f in INVOICE_FIELDS
        ]
        return F.map_from_entries(F.array_compact(F.array(*pairs)))

    items = [F.col("_model_line_items").alias("line_items")] if "line_items" in modelled else []
    return df.select(
        *[F.col(c) for c in text_df.columns],
        *[F.col(f"_value_{f}").alias(f) for f in INVOICE_FIELDS],
        *items,
        known(lambda f: _confidence(f, F.col(f"_source_{f}"))).alias("confidence"),
        known(lambda f: F.col(f"_source_{f}")).alias("source"),
    )


def merge_by_confidence(extractions: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Merge a long table (key, field, value, confidence, source) to one row per key and field.

    A model value that is not null always wins; otherwise the highest confidence does, with a
    plain pattern ahead of layout when they tie. One partial and one final aggregate.
    """
    model = F.col("source") == "model"
    rank = F.struct(model, F.col("confidence"), F.col("source") == "regex")
    chosen = F.max_by(F.struct("value", "confidence", "source"), rank)
    return (
        extractions.filter(~model | F.col("value").isNotNull())
        .groupBy(key, "field")
        .agg(chosen.alias("chosen"))
        .select(key, "field", "chosen.value", "chosen.confidence", "chosen.source")
    )


def to_wide(merged: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Long merged fields to one invoice row per key, with a confidence map.

    The map has at most one entry per invoice field, since the input has one row per field.
    """
    known = merged.filter(F.col("field").isin(INVOICE_FIELDS))

    def value(field: str) -> Column:
        found = F.max(F.when(F.col("field") == field, F.col("value")))
        return found.try_cast("double") if field in AMOUNT_FIELDS else found

    def confidence(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("confidence")))

    wide = known.groupBy(key).agg(
        *[value(f).alias(f) for f in INVOICE_FIELDS],
        F.struct(*[confidence(f).alias(f) for f in INVOICE_FIELDS]).alias("confidence"),
    )
    return wide
