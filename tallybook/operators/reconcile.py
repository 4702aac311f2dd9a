"""Comparison and merge of two extractions of the same invoices.

The left side is the local extraction ("PDF" in reasons), the right side the model's
("Google"). Both hold one row per ``invoice_id``; the join is a full outer equi-join, and a
missing side counts as an empty invoice. Everything after the join is a narrow projection.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.pycompat import exceeds, let, py_float_text, py_one_decimal, pystrip
from tallybook.functions.similarity import similarities, similarity_bound
from tallybook.operators.stats import extracted_fields

TEXT, AMOUNT, ITEMS = "text", "amount", "items"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    left_weight: float
    right_weight: float


# Fields in comparison order, with the confidence of a value from each side.
FIELDS = [
    Field("invoice_number", TEXT, 85.0, 95.0),
    Field("vendor_name", TEXT, 80.0, 90.0),
    Field("vendor_address", TEXT, 75.0, 85.0),
    Field("buyer_name", TEXT, 80.0, 90.0),
    Field("buyer_address", TEXT, 75.0, 85.0),
    Field("invoice_date", TEXT, 85.0, 95.0),
    Field("due_date", TEXT, 80.0, 90.0),
    Field("currency", TEXT, 90.0, 95.0),
    Field("subtotal", AMOUNT, 85.0, 90.0),
    Field("tax_amount", AMOUNT, 85.0, 90.0),
    Field("total_amount", AMOUNT, 90.0, 95.0),
    Field("payment_terms", TEXT, 70.0, 80.0),
    Field("line_items", ITEMS, 75.0, 85.0),
]
TEXT_FIELDS = [f.name for f in FIELDS if f.kind == TEXT]
REQUIRED = ["invoice_number", "vendor_name", "total_amount", "invoice_date"]
MAX_DIFFERENCE = 5.0
MIN_SIMILARITY = 0.85
MISMATCH_PENALTY = 5.0


def has_value(c: Column, kind: str) -> Column:
    """Not null, not blank, not an empty list. Zero counts as a value."""
    if kind == TEXT:
        # A text that starts with a visible ASCII character need not be stripped.
        return F.coalesce(((c >= "!") & (c < "\x7f")) | (pystrip(c) != ""), F.lit(False))
    if kind == ITEMS:
        return F.coalesce(c > 0, F.lit(False))
    return c.isNotNull()


def difference_percent(left: Column, right: Column) -> Column:
    """How far the right amount is from the left one, in percent of the left."""
    return F.when(left != 0, F.abs(right - left) / F.abs(left) * 100).otherwise(
        F.when(right != 0, 100.0).otherwise(0.0)
    )


def pair_sources(left: DataFrame, right: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Full outer join of both sides as struct columns ``l`` and ``r``.

    Rows without a key pair with nothing. A second join column, a hash of the row where the key is null,
    keeps them from meeting in one task.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != key]
        # Maps have no hash; one of the texts and numbers is enough to spread rows.
        plain = [c for c in fields if df.schema[c].dataType.typeName() in ("string", "double", "long", "integer")]
        spread = F.when(F.col(key).isNull(), F.xxhash64(*plain) if plain else F.lit(1)).otherwise(F.lit(0))
        return df.select(F.col(key), spread.cast("long").alias("__spread"), F.struct(*fields).alias(name))

    return side(left, "l").join(side(right, "r"), [key, "__spread"], "full_outer").drop("__spread")


def _compared(
    field: Column,
    shown: tuple[Column, Column],
    has: tuple[Column, Column],
    weights: tuple[Column, Column],
    reason: Column,
    agreed: Column,
    differs: Column,
    advice: str,
) -> Column:
    """One entry of ``field_comparisons``; ``reason`` and ``agreed`` hold when both sides have a value."""
    l_has, r_has = has
    both = l_has & r_has
    mismatch = both & differs
    return F.struct(
        field.alias("field_name"),
        shown[0].alias("pdf_value"),
        shown[1].alias("google_value"),
        F.when(r_has, shown[1]).when(l_has, shown[0]).alias("selected_value"),
        F.when(both, reason)
        .when(l_has, "Google unavailable, using PDF")
        .when(r_has, "PDF unavailable, using Google")
        .otherwise("Both sources missing")
        .alias("selection_reason"),
        F.when(both, agreed).when(l_has, weights[0]).when(r_has, weights[1]).otherwise(0.0).alias("confidence_score"),
        mismatch.alias("is_mismatch"),
        F.when(mismatch, advice).alias("recommendation"),
    )


def _compare_text(entry: Column, ratio: Column) -> Column:
    similarity = F.coalesce(ratio, F.lit(1.0))
    differs = similarity <= MIN_SIMILARITY
    reason = F.concat(
        F.when(differs, "Different values (similarity=").otherwise("Similar values (similarity="),
        py_one_decimal(similarity * 100),
        F.when(differs, "%), using Google").otherwise("%), preferring Google"),
    )
    left, right = entry["left"], entry["right"]
    return _compared(
        entry["field"],
        (left, right),
        (entry["left_has"], entry["right_has"]),
        (entry["left_weight"], entry["right_weight"]),
        reason,
        entry["right_weight"],
        differs,
        "Values differ significantly, review recommended",
    )


def _compare_amount(entry: Column) -> Column:
    left, right = entry["left"], entry["right"]

    def compared(shown: Column) -> Column:
        difference = shown["difference"]
        reason = F.concat(
            F.lit("Google preferred (Google="),
            shown["right"],
            F.lit(", PDF="),
            shown["left"],
            F.lit(", diff="),
            py_one_decimal(difference),
            F.lit("%)"),
        )
        return _compared(
            entry["field"],
            (shown["left"], shown["right"]),
            (entry["left_has"], entry["right_has"]),
            (entry["left_weight"], entry["right_weight"]),
            reason,
            entry["right_weight"],
            exceeds(difference, MAX_DIFFERENCE),
            "Manual review recommended",
        )

    shown = F.struct(
        py_float_text(left).alias("left"),
        py_float_text(right).alias("right"),
        difference_percent(left, right).alias("difference"),
    )
    return let(shown, compared)


def _compare_items(field: Field, left: Column, right: Column, nested: bool) -> Column:
    l_count, r_count = (F.size(left), F.size(right)) if nested else (left, right)
    ln, rn = l_count.cast("string"), r_count.cast("string")
    differs = l_count > r_count
    reason = (
        F.when(
            differs,
            F.concat(F.lit("PDF has more items, still using Google (Google="), rn, F.lit(", PDF="), ln, F.lit(")")),
        )
        .when(r_count > l_count, F.concat(F.lit("Google has more items ("), rn, F.lit(" vs "), ln, F.lit(")")))
        .otherwise(F.concat(F.lit("Same count, preferring Google ("), rn, F.lit(" items)")))
    )
    return _compared(
        F.lit(field.name),
        (F.to_json(left), F.to_json(right)) if nested else (ln, rn),
        (has_value(l_count, ITEMS), has_value(r_count, ITEMS)),
        (F.lit(field.left_weight), F.lit(field.right_weight)),
        reason,
        F.when(differs, 75.0).when(r_count > l_count, 90.0).otherwise(85.0),
        differs,
        "Item count mismatch, review recommended",
    )


def _source_metadata(side: str, label: str, nested: bool, at: Column) -> Column:
    count = extracted_fields(lambda name: F.col(f"{side}.{name}"), nested)
    described = F.struct(
        F.lit(label).alias("source_type"),
        F.when(count >= 6, 85.0).otherwise(60.0).alias("confidence"),
        at.alias("timestamp"),
        (count >= 8).alias("is_complete"),
        count.alias("extracted_fields"),
    )
    return F.when(F.col(side).isNotNull(), described)


def _scored(merged: DataFrame) -> DataFrame:
    """Add ``quality_score``, ``recommendation`` and ``notes`` from the selected fields and ``mismatch_count``."""
    present = sum((F.col(f"_selected_{name}").isNotNull().cast("int") for name in REQUIRED), F.lit(0))
    score = F.col("quality_score")
    note = F.concat(
        F.lit("Quality Score: "),
        py_one_decimal(score),
        F.lit("% (Completeness="),
        py_one_decimal(F.col("_completeness")),
        F.lit("%, Mismatches="),
        F.col("mismatch_count").cast("string"),
        F.lit(")"),
    )
    rated = merged.withColumn("_completeness", present / F.lit(len(REQUIRED)) * 100).withColumn(
        "quality_score", F.greatest(F.lit(0.0), F.col("_completeness") - F.col("mismatch_count") * MISMATCH_PENALTY)
    )
    return rated.withColumns(
        {
            "recommendation": F.when(score >= 85, "approve").when(score >= 60, "review").otherwise("reject"),
            "notes": F.array(note),
        }
    )


def merge_scores(
    left: DataFrame, right: DataFrame, merged_at: str | dt.datetime | Column, key: str = "invoice_id"
) -> DataFrame:
    """What ``merge_sources`` says of the quality of each merge, without the comparisons and their reasons.

    Columns: key, ``mismatch_count``, ``quality_score``, ``recommendation``, ``notes``, ``pdf_source``, ``google_source``.
    A mismatch of texts needs no more than which side of the limit their similarity lies on: bounds decide nearly all
    pairs, and only the others have it computed.
    """
    nested = "line_items" in left.columns and "line_items" in right.columns
    items_column = "line_items" if nested else "item_count"
    at = merged_at if isinstance(merged_at, Column) else F.lit(str(merged_at))

    def sides(field: Field) -> tuple[Column, Column]:
        name = items_column if field.kind == ITEMS else field.name
        a, b = F.col(f"l.{name}"), F.col(f"r.{name}")
        return (F.size(a), F.size(b)) if field.kind == ITEMS and nested else (a, b)

    texts = F.array(*[F.struct(sides(f)[0].alias("left"), sides(f)[1].alias("right")) for f in FIELDS if f.kind == TEXT])
    paired = pair_sources(left, right, key).withColumn("_texts", texts)
    paired = paired.withColumn("_bounds", F.transform("_texts", lambda t: similarity_bound(t["left"], t["right"])))
    undecided = F.zip_with("_texts", "_bounds", lambda t, bound: F.when(bound > MIN_SIMILARITY, t))
    rated = paired.withColumn("_ratios", similarities(undecided))
    differ = F.zip_with("_bounds", "_ratios", lambda bound, ratio: F.least(bound, ratio) <= MIN_SIMILARITY)

    def mismatch(field: Field) -> Column:
        a, b = sides(field)
        differs = a > b if field.kind == ITEMS else exceeds(difference_percent(a, b), MAX_DIFFERENCE)
        return (has_value(a, field.kind) & has_value(b, field.kind) & differs).cast("int")

    def selected(field: Field) -> Column:
        a, b = sides(field)
        return F.when(has_value(b, field.kind), b).when(has_value(a, field.kind), a)

    others = sum((F.coalesce(mismatch(f), F.lit(0)) for f in FIELDS if f.kind != TEXT), F.lit(0))
    counted = rated.withColumns(
        {
            "mismatch_count": F.size(F.filter(differ, lambda d: d)) + others,
            **{f"_selected_{f.name}": selected(f) for f in FIELDS if f.name in REQUIRED},
        }
    )
    return _scored(counted).select(
        key, "mismatch_count", "quality_score", "recommendation", "notes",
        _source_metadata("l", "pdf_local", nested, at).alias("pdf_source"),
        _source_metadata("r", "google_vision", nested, at).alias("google_source"),
    )


def merge_sources(
    left: DataFrame, right: DataFrame, merged_at: str | dt.datetime | Column, key: str = "invoice_id"
) -> DataFrame:
    """One row per invoice with the merged fields and the full account of the merge.

    Columns: key, merged invoice fields, ``field_comparisons``, ``mismatches``, ``notes``,
    ``quality_score``, ``recommendation``, the metadata of both sources, both inputs, and
    ``merge_timestamp``. Items are compared by count: nested as ``line_items``, or as a
    pre-aggregated ``item_count``.
    """
    nested = "line_items" in left.columns and "line_items" in right.columns
    items_column = "line_items" if nested else "item_count"
    at = merged_at if isinstance(merged_at, Column) else F.lit(str(merged_at))

    def column(side: str, field: Field) -> Column:
        return F.col(f"{side}.{items_column if field.kind == ITEMS else field.name}")

    def entries(kind: str) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("field"),
                    column("l", f).alias("left"),
                    column("r", f).alias("right"),
                    has_value(column("l", f), kind).alias("left_has"),
                    has_value(column("r", f), kind).alias("right_has"),
                    F.lit(f.left_weight).alias("left_weight"),
                    F.lit(f.right_weight).alias("right_weight"),
                )
                for f in FIELDS
                if f.kind == kind
            ]
        )

    def selected(field: Field) -> Column:
        left, right = column("l", field), column("r", field)
        l_value, r_value = (F.size(left), F.size(right)) if field.kind == ITEMS and nested else (left, right)
        return F.when(has_value(r_value, field.kind), right).when(has_value(l_value, field.kind), left)

    # Per kind one expression over an array of fields, so the plan stays small.
    paired = pair_sources(left, right, key).withColumns({"_texts": entries(TEXT), "_amounts": entries(AMOUNT)})
    rated = paired.withColumn("_ratios", similarities(F.col("_texts")))
    compared = rated.withColumns(
        {
            "_texts": F.zip_with("_texts", "_ratios", _compare_text),
            "_amounts": F.transform("_amounts", _compare_amount),
            **{f"_selected_{f.name}": selected(f) for f in FIELDS},
        }
    )
    head = TEXT_FIELDS.index("payment_terms")
    items = FIELDS[-1]
    comparisons = F.concat(
        F.slice("_texts", 1, head),
        F.col("_amounts"),
        F.slice("_texts", head + 1, 1),
        F.array(_compare_items(items, column("l", items), column("r", items), nested)),
    )
    merged = _scored(
        compared.withColumn("field_comparisons", comparisons).withColumn(
            "mismatch_count", F.size(F.filter("field_comparisons", lambda c: c["is_mismatch"]))
        )
    )

    def described(c: Column) -> Column:
        none = F.lit("None")
        return F.concat(
            c["field_name"],
            F.lit(": PDF="),
            F.coalesce(c["pdf_value"], none),
            F.lit(", Google="),
            F.coalesce(c["google_value"], none),
            F.lit(", Selected="),
            F.coalesce(c["selected_value"], none),
            F.lit(" ("),
            c["selection_reason"],
            F.lit(")"),
        )

    return merged.select(
        key,
        *[F.col(f"_selected_{f.name}").alias(items_column if f.kind == ITEMS else f.name) for f in FIELDS],
        "field_comparisons",
        F.transform(F.filter("field_comparisons", lambda c: c["is_mismatch"]), described).alias("mismatches"),
        "mismatch_count",
        "notes",
        "quality_score",
        "recommendation",
        _source_metadata("l", "pdf_local", nested, at).alias("pdf_source"),
        _source_metadata("r", "google_vision", nested, at).alias("google_source"),
        F.col("l").alias("pdf_data"),
        F.col("r").alias("google_data"),
        at.alias("merge_timestamp"),
    )


def field_comparisons(merged: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The comparisons of merged invoices as one row per invoice and field."""
    return merged.select(key, F.inline_outer("field_comparisons"))
