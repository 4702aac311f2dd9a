"""Lenient date reading, as column expressions plus an Arrow UDF for unusual texts.

A parsed date is ``struct<day date, tod bigint, zoned boolean>``: the calendar day, the
microseconds since midnight, and whether a zone was given (day and time are then UTC). The
form does not depend on the session time zone.
"""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions import patterns as P
from tallybook.functions.normalize import month_number
from tallybook.functions.pycompat import let, pystrip, truthy_text

PARSED_TYPE = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("tod", T.LongType()),
        T.StructField("zoned", T.BooleanType()),
    ]
)

_MONTH = "(" + "|".join(P.MONTH_NAMES + P.MONTHS) + ")"
# Native forms, tried in this order, each with its rearrangement to year-month-day.
# Month-first unless the first number cannot be a month.
_NUMERIC_FORMS = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
    (r"^(1[3-9]|[2-9]\d)([-/.])(\d{1,2})\2(\d{4})$", "$4-$3-$1"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", "$4-$1-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
]
_NAMED_FORMS = [
    (rf"(?i)^(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})$", 3, 2, 1),
    (rf"(?i)^{_MONTH} (\d{{1,2}}),? (\d{{4}})$", 3, 1, 2),
]
_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
# Letters and light punctuation without a month or weekday name never make a date.
_WORDS_ONLY = r"^[A-Za-z ,.'-]*$"
_CALENDAR_WORD = "(?i)(" + "|".join(P.MONTHS + P.WEEKDAYS) + ")"


def native_day(c: Column) -> Column:
    """The day of the common invoice date forms; null for anything else or an unreal day.

    The forms with month names, the longest part, are a lambda: with them the generated method of two dates would be too
    long for the JIT compiler.
    """
    s = pystrip(c)
    text = F.when(s.rlike(_ISO_DAY), s)
    for form, order in _NUMERIC_FORMS:
        text = text.when(s.rlike(form), F.regexp_replace(s, form, order))
    return F.nullif(text.otherwise(let(s, _named_day)), F.lit("")).try_cast("date")


def _named_day(s: Column) -> Column:
    """Year, month and day of a stripped text with the name of a month."""
    text = F.lit(None).cast("string")
    for form, year, month, day in reversed(_NAMED_FORMS):
        parts = F.concat_ws(
            "-",
            F.regexp_extract(s, form, year),
            month_number(F.regexp_extract(s, form, month)),
            F.regexp_extract(s, form, day),
        )
        text = F.when(s.rlike(form), parts).otherwise(text)
    return text


def mere_words(c: Column) -> Column:
    """Text that cannot be a date in any reading: words without a month or weekday name."""
    return c.rlike(_WORDS_ONLY) & ~c.rlike(_CALENDAR_WORD)


def _parse_text(text: str, default: dt.datetime) -> tuple[dt.date, int, bool] | None:
    from dateutil import parser

    try:
        value = parser.parse(text, default=default)
        zoned = value.utcoffset() is not None
        if zoned:
            value = (value - value.utcoffset()).replace(tzinfo=None)
    except (ValueError, TypeError, OverflowError):
        return None
    tod = ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
    return value.date(), tod, zoned


@F.arrow_udf(PARSED_TYPE)
def _parse_unusual(texts: pa.Array, as_of: pa.Array) -> pa.Array:
    out_type = pa.struct([("day", pa.date32()), ("tod", pa.int64()), ("zoned", pa.bool_())])
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), out_type)
    seen: dict = {}
    out = []
    for key in zip(texts.to_pylist(), as_of.to_pylist()):
        if key[0] is None or key[1] is None:
            out.append(None)
            continue
        if key not in seen:
            parsed = _parse_text(key[0], dt.datetime.combine(key[1], dt.time()))
            seen[key] = None if parsed is None else dict(zip(("day", "tod", "zoned"), parsed))
        out.append(seen[key])
    return pa.array(out, out_type)


def with_parsed_date(df: DataFrame, name: str, text: str, as_of: Column, unusual: bool = True) -> DataFrame:
    """Add the lenient reading of a date text as column ``name``; its ``day`` is null if it is none.

    Parts that the text leaves out come from ``as_of`` (a date), so ``March`` is that month of
    the ``as_of`` year. Only texts that no native form decides reach the Arrow UDF; with
    ``unusual=False`` those count as unparseable and the plan stays free of Python.
    """
    native = f"{name}_native"
    df = df.withColumn(native, native_day(F.col(text)))
    plain = F.struct(
        F.col(native).alias("day"), F.lit(0).cast("bigint").alias("tod"), F.lit(False).alias("zoned")
    )
    if not unusual:
        return df.withColumn(name, plain).drop(native)
    undecided = F.col(native).isNull() & truthy_text(F.col(text)) & ~mere_words(F.col(text))
    read = _parse_unusual(F.when(undecided, F.col(text)), as_of.cast("date"))
    return df.withColumn(name, F.coalesce(read, plain)).drop(native)


def with_distinct_dates(df: DataFrame, name: str, text: str, as_of: Column) -> DataFrame:
    """``with_parsed_date`` where many rows have the same unusual texts: each is read once, whatever its rows.

    The different undecided texts are read and joined back. Decided rows have a key of their own each, so that they do
    not meet in one task.
    """
    native = native_day(F.col(text))
    undecided = native.isNull() & truthy_text(F.col(text)) & ~mere_words(F.col(text))
    rows = df.withColumns({"_native": native, "_unusual": F.when(undecided, F.col(text)), "_as_of": as_of.cast("date")})
    own = F.when(F.col("_unusual").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(-1).cast("long"))).withColumn("_unusual", F.coalesce("_unusual", F.lit("")))
    different = rows.where("_own = -1").select("_unusual", "_as_of", "_own").distinct()
    read = different.withColumn("_read", _parse_unusual(F.col("_unusual"), F.col("_as_of")))
    plain = F.struct(F.col("_native").alias("day"), F.lit(0).cast("bigint").alias("tod"), F.lit(False).alias("zoned"))
    joined = rows.join(read, ["_own", "_unusual", "_as_of"], "left")
    return joined.withColumn(name, F.coalesce("_read", plain)).select(*df.columns, name)


def whole_days(later_day: Column, later_tod: Column, earlier_day: Column, earlier_tod: Column) -> Column:
    """Whole days between two moments, rounded down."""
    return F.date_diff(later_day, earlier_day) - F.when(later_tod < earlier_tod, 1).otherwise(0)
