"""Answers of hosted models and entity lists of a document service, turned into invoice rows.

The services are not called here; their answers are input rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import jsonvalues as J
from tallybook.functions.normalize import (
    gst_well_formed,
    normalize_amount,
    normalize_date,
    normalize_gst,
    normalize_text,
)
from tallybook.functions.pycompat import py_float, pystrip, truthy_text
from tallybook.schema import AMOUNT_FIELDS, GST_FIELDS, GST_ITEM_TYPE, INVOICE_FIELDS, ITEM_TYPE, TEXT_FIELDS
from tallybook.sources.invoice_json import ITEM_NUMBERS, strict_error, strict_fields

# Entity types of the document service and the invoice field each one fills.
ENTITY_FIELDS = {
    "supplier_name": "supplier_name",
    "supplier_address": "supplier_address",
    "supplier_gst": "supplier_gst",
    "vendor_name": "supplier_name",
    "vendor_address": "supplier_address",
    "customer_name": "customer_name",
    "customer_address": "customer_address",
    "customer_gst": "customer_gst",
    "buyer_name": "customer_name",
    "buyer_address": "customer_address",
    "invoice_number": "invoice_number",
    "invoice_date": "invoice_date",
    "due_date": "due_date",
    "subtotal": "subtotal",
    "tax_amount": "tax_amount",
    "total_amount": "total_amount",
}
MIN_ENTITY_CONFIDENCE = 0.7


def strip_fences(response: Column) -> Column:
    """The response without a leading code fence (tagged or bare) and a trailing one."""
    s = pystrip(response)
    for fence in (r"^```json", r"^```", r"```\z"):
        s = F.regexp_replace(s, fence, "")
    return pystrip(s)


def drop_fences(response: Column) -> Column:
    """The response without code fences anywhere."""
    return pystrip(F.replace(F.replace(pystrip(response), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def braced(response: Column) -> Column:
    """From the first opening to the last closing brace, null without such a pair."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def _mapped_item(item: Column) -> Column:
    fields = F.struct(
        F.try_variant_get(item, "$.description", "string").alias("description"),
        *[J.as_float(J.member(item, n)).alias(n) for n in ITEM_NUMBERS],
    )
    return F.when(J.kind(J.member(item, "description")) == "STRING", fields)


def _each(record: Column, fields: list[str], read: Callable[[Column], Column]) -> Column:
    """The named members of a record, read by one shared expression, as an array."""
    return F.transform(F.array(*[J.member(record, f) for f in fields]), read)


def _mapped_arrays(record: Column) -> dict[str, tuple[list[str], Column]]:
    """Lenient mapping: truthy values as text, readable numbers."""
    return {
        "_texts": (TEXT_FIELDS, _each(record, TEXT_FIELDS, lambda v: F.when(J.is_truthy(v), J.as_text(v)))),
        "_amounts": (AMOUNT_FIELDS, _each(record, AMOUNT_FIELDS, J.as_float)),
    }


def _mapped_items(record: Column) -> Column:
    """Items of a record, unreadable ones skipped."""
    items = F.array_compact(F.transform(J.elements(J.member(record, "line_items")), _mapped_item))
    items_type = f"array<{ITEM_TYPE.simpleString()}>"
    return F.coalesce(items.cast(items_type), F.array().cast(items_type))


def _gst_arrays(record: Column) -> dict[str, tuple[list[str], Column]]:
    dates = [f for f in GST_FIELDS if f.endswith("_date")]
    numbers = [f for f in GST_FIELDS if f.endswith("_gst")]
    texts = [f for f in GST_FIELDS if f not in dates + numbers + AMOUNT_FIELDS]
    normalizers = {
        "_texts": (texts, normalize_text),
        "_numbers": (numbers, normalize_gst),
        "_dates": (dates, normalize_date),
        "_amounts": (AMOUNT_FIELDS, normalize_amount),
    }

    return {
        name: (fields, F.transform(_each(record, fields, J.as_text), normalize))
        for name, (fields, normalize) in normalizers.items()
    }


def _gst_items(record: Column) -> Column:
    def as_texts(entry: Column) -> Column:
        parts = [J.as_text(J.member(entry, n)).alias(n) for n in GST_ITEM_TYPE.names]
        return F.when(J.kind(entry) == "OBJECT", F.struct(*parts))

    def normalized(entry: Column) -> Column:
        amounts = [normalize_amount(entry[n]).alias(n) for n in GST_ITEM_TYPE.names[1:]]
        return F.struct(normalize_text(entry["description"]).alias("description"), *amounts)

    items_type = f"array<{GST_ITEM_TYPE.simpleString()}>"
    entries = F.array_compact(F.transform(J.elements(J.member(record, "items")), as_texts))
    items = F.transform(entries, normalized).cast(items_type)
    return F.coalesce(items, F.array().cast(items_type))


def parse_responses(df: DataFrame, shape: str = "core", fences: str = "braces", response: str = "response") -> DataFrame:
    """Invoice columns from a column of model responses, and ``parsed`` for whether that worked.

    ``fences`` says how the JSON is found: ``leading`` fence, fences ``anywhere``, or between
    ``braces``. The first two load the record strictly; ``braces`` maps values leniently, and a
    response without braces is an empty invoice. ``shape="gst"`` gives the GST columns.
    """
    clean = {"leading": strip_fences, "anywhere": drop_fences, "braces": braced}[fences](F.col(response))
    kept = [c for c in df.columns if c != response]
    rows = df.select(*kept, clean.alias("_clean")).withColumn("_record", J.strict_json(F.col("_clean")))
    record = F.col("_record")
    if fences == "braces":
        parsed = F.col("_clean").isNull() | F.coalesce(J.kind(record) == "OBJECT", F.lit(False))
    else:
        parsed = strict_error(record).isNull()
    rows = rows.withColumn("parsed", parsed)

    if shape == "core" and fences != "braces":
        fields = strict_fields(record)
    else:
        arrays = _gst_arrays(record) if shape == "gst" else _mapped_arrays(record)
        rows = rows.withColumns({name: values for name, (_, values) in arrays.items()})
        read = {f: F.get(F.col(name), F.lit(i)) for name, (names, _) in arrays.items() for i, f in enumerate(names)}
        if shape == "gst":
            fields = {**{f: read[f] for f in GST_FIELDS}, "items": _gst_items(record)}
        else:
            fields = {**{f: read[f] for f in INVOICE_FIELDS}, "line_items": _mapped_items(record)}
    return rows.select(*kept, "parsed", *[F.when(F.col("parsed"), c).alias(n) for n, c in fields.items()])


def gst_flags(df: DataFrame) -> DataFrame:
    """Add whether the two tax numbers have their expected length."""
    return df.withColumns(
        {
            "supplier_gst_ok": gst_well_formed(F.col("supplier_gst")),
            "customer_gst_ok": gst_well_formed(F.col("customer_gst")),
        }
    )


def entities_to_invoice(entities: DataFrame, key: str = "invoice_id") -> DataFrame:
    """One GST-shaped row per document from entity rows (key, ord, type, value, confidence).

    Of the entities above the confidence limit the last one in ``ord`` fills its field, also
    when it has no value. One partial and one final aggregate per document.
    """
    field = F.when(F.col("type").isin(list(ENTITY_FIELDS)), F.col("type"))
    for alias, target in ENTITY_FIELDS.items():
        if alias != target:
            field = F.when(F.col("type") == alias, target).otherwise(field)
    value = F.when(truthy_text(F.col("value")), pystrip(F.col("value")))
    used = entities.select(key, "ord", field.alias("field"), value.alias("value"), "confidence")
    usable = (F.col("confidence") > MIN_ENTITY_CONFIDENCE) & F.col("field").isNotNull()
    last = [
        F.max_by(F.col("value"), F.when(usable & (F.col("field") == f), F.col("ord"))).alias(f) for f in GST_FIELDS
    ]
    return used.groupBy(key).agg(*last)


def gst_to_invoice(df: DataFrame, map_parties: bool = False) -> DataFrame:
    """GST-shaped rows to invoice columns.

    By default only the fields that both shapes name alike survive. ``map_parties=True`` also
    maps supplier, customer and items.
    """
    gst = set(GST_FIELDS) | {"items"}
    kept = [c for c in df.columns if c not in gst]
    parties = {
        "vendor_name": "supplier_name",
        "vendor_address": "supplier_address",
        "buyer_name": "customer_name",
        "buyer_address": "customer_address",
    }
    columns = []
    for field in INVOICE_FIELDS:
        if field in AMOUNT_FIELDS:
            columns.append(py_float(F.col(field)).alias(field))
        elif field in df.columns:
            columns.append(F.col(field))
        elif map_parties and field in parties:
            columns.append(F.col(parties[field]).alias(field))
        else:
            columns.append(F.lit(None).cast("string").alias(field))
    items_type = f"array<{ITEM_TYPE.simpleString()}>"
    items = F.array().cast(items_type)
    if map_parties and "items" in df.columns:
        items = F.transform(
            F.filter("items", lambda i: i["description"].isNotNull()),
            lambda i: F.struct(
                i["description"].alias("description"),
                py_float(i["quantity"]).alias("quantity"),
                py_float(i["unit_price"]).alias("price"),
                py_float(i["amount"]).alias("total"),
            ),
        ).cast(items_type)
    return df.select(*kept, *columns, items.alias("line_items"))


def gst_json(df: DataFrame) -> DataFrame:
    """Add ``json``: the GST record without null fields and without an empty item list."""
    items = [F.when(F.size("items") > 0, F.col("items")).alias("items")] if "items" in df.columns else []
    # Item list between the dates and the amounts.
    return df.withColumn("json", F.to_json(F.struct(*GST_FIELDS[:9], *items, *GST_FIELDS[9:])))
