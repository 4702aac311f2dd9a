"""Reading JSON values with the type they were written in, on Spark's variant type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.pycompat import let, py_float, py_float_text, pystrip


def strict_json(text: Column) -> Column:
    """The text as one JSON value, null if malformed or followed by anything else.

    The text is read as the only element of an array, since the parser by itself ignores what
    follows the first value.
    """

    def only(wrapped: Column) -> Column:
        alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
        return F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), pystrip(text), F.lit("]"))), only)


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, OBJECT or ARRAY; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def by_kind(value: Column, read: Callable[[Column, Column], Column]) -> Column:
    """``read`` of a value and its kind, both found once: the kind is the schema of the whole value."""
    return let(value, lambda v: let(kind(v), lambda k: read(v, k)))


def is_number(k: Column) -> Column:
    return k.isin("BIGINT", "DECIMAL", "DOUBLE")


def absent(k: Column) -> Column:
    return k.isNull() | (k == "VOID")


def as_text(value: Column) -> Column:
    """``str(value)`` of a JSON scalar; nested values give their JSON text."""

    def read(v: Column, k: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        number = F.try_variant_get(v, "$", "double")
        return (
            F.when(absent(k), F.lit(None).cast("string"))
            .when(k == "STRING", text)
            .when(k == "BOOLEAN", F.initcap(text))
            .when((k == "DECIMAL") & text.rlike("^-?[0-9]{19,}$"), text)
            .when(k.isin("DECIMAL", "DOUBLE"), py_float_text(number))
            .otherwise(text)
        )

    return by_kind(value, read)


def as_float(value: Column) -> Column:
    """``float(value)``, null where that fails."""
    return by_kind(value, float_of)


def float_of(v: Column, k: Column) -> Column:
    """``as_float`` of a value of a known kind."""
    return (
        F.when(is_number(k) | (k == "BOOLEAN"), F.try_variant_get(v, "$", "double"))
        .when(k == "STRING", py_float(F.try_variant_get(v, "$", "string")))
    )


def is_truthy(value: Column) -> Column:
    """Python truthiness of a JSON value."""

    def read(v: Column, k: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        return F.coalesce(
            F.when(absent(k), False)
            .when(k == "STRING", text != "")
            .when(is_number(k), F.try_variant_get(v, "$", "double") != 0)
            .when(k == "BOOLEAN", text == "true")
            .otherwise(~text.isin("[]", "{}")),
            F.lit(False),
        )

    return by_kind(value, read)


def elements(value: Column) -> Column:
    """The elements of a JSON array, null if it is not one."""
    return F.try_variant_get(value, "$", "array<variant>")
