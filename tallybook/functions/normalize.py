"""Normalisers: text, date, amount, tax number and currency, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions import patterns as P
from tallybook.functions.pycompat import capture, empty_to_null, let, pystrip, regex, truthy_text


def calendar_text(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd`` if the parts name a real day of years 1 to 9999, else null."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "0000") & text.try_cast("date").isNotNull(), text)


def month_number(name: Column) -> Column:
    """Two-digit month number of an English month name, by its first three letters."""
    position = F.array_position(F.array(*[F.lit(m) for m in P.MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(position > 0, F.lpad(position.cast("string"), 2, "0"))


def normalize_text(c: Column) -> Column:
    """Strip, collapse whitespace runs to one space, empty to null."""
    return empty_to_null(F.regexp_replace(pystrip(c), regex(r"\s+"), " "))


def _date_shapes() -> list[tuple[str, int, int, int]]:
    """Accepted date shapes in the order tried, with the groups of year, month and day."""
    full = "|".join(P.MONTH_NAMES)
    short = "|".join(P.MONTHS)
    return [
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
        (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1),
        (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1),
        (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3),
        (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3),
        (rf"^({full})\s+(\d{{1,2}}),\s+(\d{{4}})$", 3, 1, 2),
        (rf"^({full})\s+(\d{{1,2}})\s+(\d{{4}})$", 3, 1, 2),
        (rf"^(\d{{1,2}})\s+({full})\s+(\d{{4}})$", 3, 2, 1),
        (rf"^(\d{{1,2}})-({short})-(\d{{4}})$", 3, 2, 1),
        (rf"^(\d{{1,2}})/({short})/(\d{{4}})$", 3, 2, 1),
        (rf"^(\d{{1,2}})\s+({short})\s+(\d{{4}})$", 3, 2, 1),
        (rf"^({short})\s+(\d{{1,2}}),\s+(\d{{4}})$", 3, 1, 2),
    ]


def normalize_date(c: Column) -> Column:
    """``yyyy-MM-dd`` where a known format matches, month-first before day-first; else as given.

    A text already shaped like an ISO date is passed through without a calendar check.
    """
    def iso(s: Column) -> Column:
        found = []
        for shape, year, month, day in _date_shapes():
            pattern = regex(shape)
            month_part = F.regexp_extract(s, pattern, month)
            if "jan" in shape:
                month_part = month_number(month_part)
            text = calendar_text(F.regexp_extract(s, pattern, year), month_part, F.regexp_extract(s, pattern, day))
            found.append(F.when(s.rlike(pattern), text))
        return F.when(s.rlike(r"(?U)^\d{4}-\d{2}-\d{2}$"), s).otherwise(F.coalesce(*found, s))

    return F.when(truthy_text(c), let(pystrip(c), iso))


def normalize_amount(c: Column) -> Column:
    """Amount text without currency signs and separators, null if no number is left."""
    kept = F.regexp_replace(c, r"(?U)[^\d.\-]", "")
    return F.when(truthy_text(c) & kept.rlike(r"(?U)^-?(\d+\.?\d*|\.\d+)$"), kept)


def normalize_gst(c: Column) -> Column:
    """Upper-case letters and digits of a tax number, empty to null."""
    return empty_to_null(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""))


def gst_well_formed(c: Column) -> Column:
    """Whether a normalised tax number has the expected 15 characters; null stays null."""
    return F.length(c) == 15


def to_layout_date(c: Column) -> Column:
    """ISO text from the first date found in a line, parts re-arranged without a calendar check.

    Two-digit numeric dates are read day-first.
    """

    def iso(pattern: str, groups: tuple[int, int, int]) -> Column:
        def rearranged(found: Column) -> Column:
            year, month, day = (F.regexp_extract(found, regex(pattern), g) for g in groups)
            if "Jan" in pattern:
                month = month_number(month)
            return F.concat_ws("-", year, month, F.lpad(day, 2, "0"))

        return let(capture(c, pattern, 0), lambda found: F.when(found.isNotNull(), rearranged(found)))

    return F.coalesce(*[iso(pattern, groups) for pattern, groups in P.LAYOUT_DATES])


def parse_amount_basic(captured: Column) -> Column:
    """The legacy reading of a captured amount: commas *and* dots are dropped.

    If both occur, the first two comma-separated parts become the whole and the fraction, and
    the value is null unless that is a number.
    """
    parts = F.split(captured, ",")
    both = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.", ""), F.lit("."), F.get(parts, F.lit(1)))
    text = F.when(captured.contains(",") & captured.contains("."), both).otherwise(
        F.regexp_replace(captured, "[,.]", "")
    )
    return plain_number(text)


def parse_amount_normalized(captured: Column) -> Column:
    """A captured amount with its commas dropped, null if that is not a number."""
    return plain_number(F.regexp_replace(captured, ",", ""))


def plain_number(text: Column) -> Column:
    return F.when(text.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double"))


def currency_basic(text: Column) -> Column:
    """Code of the first currency mark in the fixed order, EUR if there is none."""
    code = F.when(text.contains(P.CURRENCY_MARKS[0][0]), F.lit(P.CURRENCY_MARKS[0][1]))
    for mark, name in P.CURRENCY_MARKS[1:]:
        code = code.when(text.contains(mark), F.lit(name))
    return code.otherwise(F.lit(P.DEFAULT_CURRENCY))


def currency_layout(text: Column) -> Column:
    """USD or EUR if their sign or code occurs, else null."""
    return F.when(text.contains("$") | text.contains("USD"), F.lit("USD")).when(
        text.contains("€") | text.contains("EUR"), F.lit("EUR")
    )
