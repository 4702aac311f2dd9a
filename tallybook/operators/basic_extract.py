"""Pattern extraction of invoice fields from document text, English and German.

Everything is a column expression over one row. The first pattern that matches wins and later
patterns are not evaluated for that row. Functions take the text in folded form as well: a pattern is then tried only
on texts that have the word it starts with, and most texts have few of the many labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import patterns as P
from tallybook.functions.normalize import (
    currency_basic,
    parse_amount_basic,
    parse_amount_normalized,
    plain_number,
)
from tallybook.functions.pycompat import (
    capture,
    contains_any,
    first_capture,
    fold,
    let,
    line_after,
    lines_after,
    matches,
    pystrip,
    regex,
)

ITEM_ARRAY = "array<struct<description:string,quantity:double,price:double,total:double>>"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def invoice_number(text: Column, folded: Column | None = None) -> Column:
    return pystrip(first_capture(text, P.INVOICE_NUMBER, folded=folded))


def first_usable(lines: Column, shortest: int, longest: int | None, stop_words: list[str]) -> Column:
    """The first of the first ten lines with a usable length and without a stop word."""

    def usable(line: Column) -> Column:
        long_enough = F.length(line) >= shortest
        fits = long_enough if longest is None else long_enough & (F.length(line) <= longest)
        return fits & let(F.lower(line), lambda lowered: ~contains_any(lowered, stop_words))

    def first(lines: Column) -> Column:
        # One after the other, so that lines after the first usable one are not read.
        return F.coalesce(*[let(pystrip(F.get(lines, F.lit(i))), lambda line: F.when(usable(line), line)) for i in range(10)])

    return let(lines, first)


def vendor_name(lines: Column) -> Column:
    return first_usable(lines, 3, 99, P.VENDOR_STOP_WORDS)


def buyer_name(text: Column, folded: Column | None = None) -> Column:
    return pystrip(first_capture(text, [line_after(label) for label in P.BUYER_NAME_LABELS], folded=folded))


def buyer_address(text: Column, folded: Column | None = None) -> Column:
    patterns = [lines_after(label, P.BUYER_ADDRESS_LINES) for label in P.BUYER_ADDRESS_LABELS]
    return pystrip(first_capture(text, patterns, folded=folded))


def vendor_address(lines: Column) -> Column:
    """Street lines among the first 15, up to and including the first line that is only a ZIP line."""

    def marked(line: Column) -> Column:
        # Nothing before the first digit matters to either kind of line.
        return let(F.regexp_replace(line, r"(?U)^\D+", ""), lambda rest: marks_of(line, rest))

    def marks_of(line: Column, rest: Column) -> Column:
        has_digit = rest != ""
        street = has_digit & let(fold(rest), lambda folded: contains_any(folded, P.STREET_WORDS))
        zip_code = has_digit & matches(rest, P.ZIP_LINE, ignore_case=False)
        return F.struct(line.alias("line"), street.alias("street"), zip_code.alias("zip"))

    def collect(marks: Column) -> Column:
        zip_at = F.array_position(F.transform(marks, lambda m: m["zip"] & ~m["street"]), True)
        kept = F.when(zip_at > 0, F.slice(marks, F.lit(1), zip_at.cast("int"))).otherwise(marks)
        used = F.filter(kept, lambda m: m["street"] | m["zip"])
        return F.when(F.size(used) > 0, F.array_join(F.transform(used, lambda m: pystrip(m["line"])), " "))

    return let(F.transform(F.slice(lines, 1, 15), marked), collect)


def date_text(text: Column, labels: list[str], folded: Column | None = None) -> Column:
    """The first date after a label. A labelled line without a date leads on to the next label."""
    found = [
        let(pystrip(capture(text, label, folded=folded)), lambda line: first_capture(line, P.DATE_IN_LINE, group=0))
        for label in labels
    ]
    return F.coalesce(*found)


def amount(
    text: Column, patterns: list[str], amounts: str = "legacy", lookbehind: str = "", folded: Column | None = None
) -> Column:
    """The first pattern whose capture reads as a number."""
    parse = {"legacy": parse_amount_basic, "normalized": parse_amount_normalized}[amounts]
    return F.coalesce(*[let(capture(text, p, folded=folded, before=lookbehind), parse) for p in patterns])


def payment_terms(text: Column, folded: Column | None = None) -> Column:
    groups = [g for _, g in P.PAYMENT_TERMS]
    return pystrip(first_capture(text, [p for p, _ in P.PAYMENT_TERMS], groups, folded=folded))


def line_items(text: Column, lines: Column | None = None, folded: Column | None = None) -> Column:
    """Items of the section between the first header line and the next closing line.

    A header line names both an item and a value column and is never an item. An item line has
    at least two numbers, all readable once commas and dots are dropped, and starts with letters.
    """

    def marked(line: Column) -> Column:
        return let(fold(line), lambda folded: marks_of(line, folded))

    def marks_of(line: Column, folded: Column) -> Column:
        header = contains_any(folded, P.ITEM_HEADER_NAMES) & contains_any(folded, P.ITEM_HEADER_VALUES)
        closing = contains_any(folded, P.ITEM_SECTION_ENDS) & ~header
        return F.struct(line.alias("line"), header.alias("header"), closing.alias("closing"))

    def position(marks: Column, name: str) -> Column:
        return F.array_position(F.transform(marks, lambda m: m[name]), True).cast("int")

    def section(marks: Column) -> Column:
        rest = let(position(marks, "header"), lambda at: F.when(at > 0, F.slice(marks, at + 1, F.size(marks))))
        return let(rest, until_closing)

    def until_closing(marks: Column) -> Column:
        body = let(
            position(marks, "closing"), lambda at: F.when(at > 0, F.slice(marks, F.lit(1), at - 1)).otherwise(marks)
        )
        return F.transform(F.filter(body, lambda m: ~m["header"]), lambda m: item(m["line"]))

    def item(line: Column) -> Column:
        captured = F.regexp_extract_all(line, F.lit(regex(P.ITEM_NUMBER, False)), F.lit(1))
        numbers = F.transform(captured, lambda n: plain_number(F.regexp_replace(n, "[,.]", "")))
        return let(numbers, lambda ns: build(line, ns))

    def build(line: Column, numbers: Column) -> Column:
        described = matches(line, P.ITEM_DESCRIPTION, ignore_case=False)
        readable = ~F.exists(numbers, lambda n: n.isNull())
        three = F.size(numbers) >= 3
        return F.when(
            described & readable & (F.size(numbers) >= 2),
            F.struct(
                pystrip(F.regexp_extract(line, regex(P.ITEM_DESCRIPTION, False), 1)).alias("description"),
                F.get(numbers, F.lit(0)).alias("quantity"),
                F.when(three, F.get(numbers, F.lit(1))).alias("price"),
                F.when(three, F.get(numbers, F.lit(2))).otherwise(F.get(numbers, F.lit(1))).alias("total"),
            ),
        )

    lines = lines_of(text) if lines is None else lines
    items = F.array_compact(let(F.transform(lines, marked), section)).cast(ITEM_ARRAY)
    # A text without the words of a header line has no section, and its lines need no reading.
    folded = fold(text) if folded is None else folded
    headed = contains_any(folded, P.ITEM_HEADER_NAMES) & contains_any(folded, P.ITEM_HEADER_VALUES)
    return F.coalesce(F.when(headed, items), F.array().cast(ITEM_ARRAY))


def extract_basic(
    df: DataFrame, text: str = "text", amounts: str = "legacy", fix_subtotal: bool = False
) -> DataFrame:
    """Add the invoice columns read from the text column by patterns.

    ``amounts="normalized"`` reads ``1,234.56`` as that number instead of the legacy reading.
    ``fix_subtotal=True`` keeps the total patterns from matching inside ``Subtotal``.
    """
    body, lines, folded = F.col(text), F.col("_lines"), F.col("_folded")
    lookbehind = "(?<!sub)" if fix_subtotal else ""
    return (
        df.withColumns({"_lines": lines_of(body), "_folded": fold(body)})
        .withColumns(
            {
                "invoice_number": invoice_number(body, folded),
                "vendor_name": vendor_name(lines),
                "buyer_name": buyer_name(body, folded),
                "vendor_address": vendor_address(lines),
                "buyer_address": buyer_address(body, folded),
                "invoice_date": date_text(body, P.INVOICE_DATE_LINE, folded),
                "due_date": date_text(body, P.DUE_DATE_LINE, folded),
                "currency": currency_basic(body),
                "total_amount": amount(body, P.TOTAL_AMOUNT, amounts, lookbehind, folded),
                "subtotal": amount(body, P.SUBTOTAL, amounts, folded=folded),
                "tax_amount": amount(body, P.TAX_AMOUNT, amounts, folded=folded),
                "payment_terms": payment_terms(body, folded),
                "line_items": line_items(body, lines, folded),
            }
        )
        .drop("_lines", "_folded")
    )
