"""Strict loading of invoices from JSON: wrong types are reported, not coerced away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import jsonvalues as J
from tallybook.schema import AMOUNT_FIELDS, INVOICE_FIELDS, ITEM_TYPE
from tallybook.sources.json_arrays import read_json_records

ITEM_NUMBERS = ["quantity", "price", "total"]
ITEMS = f"array<{ITEM_TYPE.simpleString()}>"


def _number_error(value: Column, name: Column) -> Column:
    def error(v: Column, k: Column) -> Column:
        readable = J.absent(k) | J.is_number(k) | (k == "BOOLEAN") | J.float_of(v, k).isNotNull()
        return F.when(~readable, F.concat(name, F.lit(": Input should be a valid number")))

    return J.by_kind(value, error)


def _text_error(value: Column, name: Column) -> Column:
    def error(_: Column, k: Column) -> Column:
        return F.when(~(J.absent(k) | (k == "STRING")), F.concat(name, F.lit(": Input should be a valid string")))

    return J.by_kind(value, error)


def _item_error(item: Column) -> Column:
    description = J.kind(J.member(item, "description"))
    return F.coalesce(
        F.when(J.kind(item) != "OBJECT", "line_items: Input should be a valid dictionary"),
        F.when(
            description.isNull() | (description != "STRING"),
            "line_items.description: Input should be a valid string",
        ),
        *[_number_error(J.member(item, n), F.lit(f"line_items.{n}")) for n in ITEM_NUMBERS],
    )


def _items_error(value: Column) -> Column:
    k = J.kind(value)
    errors = F.array_compact(F.transform(J.elements(value), _item_error))
    return F.when(~(J.absent(k) | (k == "ARRAY")), "line_items: Input should be a valid list").when(
        k == "ARRAY", F.get(errors, F.lit(0))
    )


def _item(item: Column) -> Column:
    return F.struct(
        F.try_variant_get(item, "$.description", "string").alias("description"),
        *[J.as_float(J.member(item, n)).alias(n) for n in ITEM_NUMBERS],
    )


def strict_fields(value: Column) -> dict[str, Column]:
    """Invoice columns of one JSON record; absent ``line_items`` give an empty list."""
    columns = {}
    for field in INVOICE_FIELDS:
        if field in AMOUNT_FIELDS:
            columns[field] = J.as_float(J.member(value, field))
        else:
            columns[field] = F.try_variant_get(value, f"$.{field}", "string")
    items = J.member(value, "line_items")
    columns["line_items"] = (
        F.when(J.kind(items).isNull(), F.array().cast(ITEMS))
        .when(J.kind(items) == "ARRAY", F.transform(J.elements(items), _item).cast(ITEMS))
    )
    return columns


def strict_error(value: Column) -> Column:
    """The first reason why a JSON record is not an invoice, or null."""
    fields = F.array(
        *[
            F.struct(
                F.lit(f).alias("name"), F.lit(f in AMOUNT_FIELDS).alias("amount"), J.member(value, f).alias("value")
            )
            for f in INVOICE_FIELDS
        ]
    )
    errors = F.transform(
        fields,
        lambda f: F.when(f["amount"], _number_error(f["value"], f["name"])).otherwise(
            _text_error(f["value"], f["name"])
        ),
    )
    return F.when(value.isNull(), "Malformed JSON").otherwise(
        F.coalesce(
            F.when(J.kind(value) != "OBJECT", "Input should be a valid dictionary"),
            F.get(F.array_compact(errors), F.lit(0)),
            _items_error(J.member(value, "line_items")),
        )
    )


def load_invoices(df: DataFrame, json: str = "value") -> DataFrame:
    """Invoice columns and ``load_error`` from a column of JSON text.

    A text holds one record or an array of records; unknown keys are ignored. A record with a
    wrong type keeps its row, with the error and without values.
    """
    kept = [c for c in df.columns if c != json]
    parsed = df.withColumn("_document", J.strict_json(F.col(json)))
    records = F.when(
        J.kind(F.col("_document")) == "ARRAY", J.elements(F.col("_document"))
    ).otherwise(F.array("_document"))
    rows = parsed.select(*kept, F.explode(records).alias("_record")).withColumn(
        "load_error", strict_error(F.col("_record"))
    )
    good = F.col("load_error").isNull()
    return rows.select(
        *kept,
        *[F.when(good, c).alias(name) for name, c in strict_fields(F.col("_record")).items()],
        "load_error",
    )


def read_invoice_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Invoices from JSON files, with the base name of each file as ``source_file``.

    ``lines=False`` reads every file as one document: one record, or an array of any size, which is read by its
    records in parallel. ``lines=True`` reads one document per line. A file or line that is not JSON is one row.
    """
    if lines:
        text = spark.read.text(path).filter(F.trim("value") != "").withColumn("file", F.input_file_name())
    else:
        text = read_json_records(spark, path).drop("part")
    return load_invoices(text.withColumn("source_file", F.element_at(F.split("file", "/"), -1)).drop("file"), "value")
