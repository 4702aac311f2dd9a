"""Column helpers that give Spark expressions the truthiness, whitespace, number and regex
rules that the invoice semantics are defined in (those of Python)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def truthy_text(c: Column) -> Column:
    """Not null and not empty. Whitespace alone is truthy."""
    return F.coalesce(c != "", F.lit(False))


def falsy_text(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def truthy_number(c: Column) -> Column:
    """Not null and not zero. NaN is truthy."""
    return F.coalesce(c != 0, F.lit(False))


def falsy_number(c: Column) -> Column:
    return F.coalesce(c == 0, F.lit(True))


def exceeds(c: Column, limit: float) -> Column:
    """``c > limit``, false for null and for NaN (Spark orders NaN above every number)."""
    return F.coalesce((c > F.lit(float(limit))) & ~F.isnan(c), F.lit(False))


def pystrip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_WHITESPACE))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def regex(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern that matches what the same pattern matches in Python.

    ``U`` makes the classes and case folding Unicode-aware, ``d`` lets ``.`` stop at ``\\n``
    only, and ``\\s`` gains the four separators that Python counts as whitespace.
    """
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


#: White space other than a line feed; a possessive run of it is never tried in parts.
BLANK = r"[\s&&[^\n]]"
#: The first line with text, after a line feed; where only white space follows, a blank that starts a line.
FIRST_LINE = rf"(?:\s*+(?!\z)|\n*+(?={BLANK}\s*+\z))([^\n]++)"


def line_after(label: str) -> str:
    """The pattern of the first line with text after a label, an optional colon and a line feed.

    It matches what ``label\\s*:?\\s*\\n\\s*([^\\n]+)`` does, but reads each run of white space once: after a colon or,
    where that has no line feed behind it, without one.
    """
    return rf"{label}(?:\s*+:{BLANK}*+\n|{BLANK}*+\n){FIRST_LINE}"


def lines_after(label: str, most: int) -> str:
    """The pattern of up to ``most`` whole lines after a label, an optional colon and blank lines.

    It matches what ``label\\s*:?\\s*\\n((?:[^\\n]+\\n){1,most})`` does. The lines start behind the last line feed of
    the white space; where the text ends within the first of them, a blank line before it is what is left to match.
    """
    starts = rf"(?:{BLANK}*+\n)++(?=[^\n])|\s*?\n(?={BLANK}++\n)"
    return rf"{label}(?:\s*+:|)(?:{starts})((?:[^\n]++\n){{1,{most}}}+)"


def literal_of(pattern: str) -> str:
    """What every match of a pattern starts with, in lower case. Only for patterns that start with a plain word or mark."""
    return re.match(r"[^\W\d_]+|#", pattern)[0].lower()


def capture(
    text: Column, pattern: str, group: int = 1, ignore_case: bool = True, folded: Column | None = None, before: str = ""
) -> Column:
    """The group of the first match, or null. Only for groups that cannot match empty.

    ``folded`` is the text as ``fold`` gives it: a text without the word that the pattern starts with is then not
    searched, others from the first such word on. ``before`` is put in front of the pattern.
    """
    if folded is None:
        return _unless_empty(F.regexp_extract(text, regex(before + pattern, ignore_case), group))
    word = literal_of(pattern)
    # Folding keeps every character in its place. What is put before a pattern may look back.
    start = text if before else F.substr(text, F.instr(folded, word))
    found = F.regexp_extract(start, regex(before + pattern, ignore_case), group)
    return F.when(folded.contains(word), _unless_empty(found))


def _unless_empty(found: Column) -> Column:
    """``empty_to_null`` for what is costly to find: in a branch or a lambda that would find it twice."""
    return F.get(F.array_remove(F.array(found), ""), F.lit(0))


def first_capture(
    text: Column,
    patterns: Sequence[str],
    group: int | Sequence[int] = 1,
    ignore_case: bool = True,
    folded: Column | None = None,
) -> Column:
    """The capture of the first pattern that matches; later patterns are not evaluated then."""
    groups = [group] * len(patterns) if isinstance(group, int) else group
    return F.coalesce(*[capture(text, p, g, ignore_case, folded) for p, g in zip(patterns, groups)])


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(regex(pattern, ignore_case))


def fold(text: Column) -> Column:
    """Lower case, with the three letters that case-insensitive patterns also match as ``i`` and ``s``."""
    special = text.contains("ı") | text.contains("ſ") | text.contains("İ")
    return F.when(special, F.lower(F.translate(text, "İıſ", "iis"))).otherwise(F.lower(text))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains any of the words."""
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def py_float(c: Column) -> Column:
    """``float(text)`` for text, null where Python raises."""
    return let(pystrip(c), _float_of_stripped)


def _float_of_stripped(s: Column) -> Column:
    bare = F.lower(F.regexp_replace(s, "^[+-]", ""))
    return (
        F.when(
            s.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"),
            F.replace(s, F.lit("_"), F.lit("")).try_cast("double"),
        )
        .when(bare.isin("inf", "infinity") & s.startswith("-"), F.lit(float("-inf")))
        .when(bare.isin("inf", "infinity"), F.lit(float("inf")))
        .when(bare == "nan", F.lit(float("nan")))
    )


def py_float_text(c: Column) -> Column:
    """``str(float)``: plain digits from 1e-4 up to 1e16, exponent form beyond."""
    size = F.abs(c)
    same_in_both = (c == 0) | ((size >= 1e-3) & (size < 1e7))
    return F.when(same_in_both, c.cast("string")).otherwise(let(let(c.cast("string"), _shortest), _respelled))


def _shortest(text: Column) -> Column:
    """Older Java versions print some numbers with a digit too many; 16 digits do if they read back."""
    value = text.try_cast("double")
    rounded = F.regexp_replace(F.format_string("%.15E", value), r"\.?0*E\+?", "E")
    return F.when(rounded.try_cast("double") == value, rounded).otherwise(text)


def _respelled(text: Column) -> Column:
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    size = F.abs(exponent)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    sign = F.when(exponent < 0, "e-").otherwise("e+")
    digits = F.when(size < 10, F.concat(F.lit("0"), size.cast("string"))).otherwise(size.cast("string"))
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    return (
        F.when(F.lower(text) == "nan", "nan")
        .when(F.lower(text) == "infinity", "inf")
        .when(F.lower(text) == "-infinity", "-inf")
        .when((exponent >= -4) & (exponent < 16), plain)
        .otherwise(F.concat(mantissa, sign, digits))
    )


def py_one_decimal(c: Column) -> Column:
    """``format(x, '.1f')`` for finite numbers.

    Numbers below a million that are clearly off the midpoint of two results are rounded as they are; a tenfold of
    that size is off by 1e-9 at most. The others go through decimals.
    """
    tenfold = c * 10.0
    clear = (c >= 0) & (c < 1e6) & (F.abs(tenfold - F.floor(tenfold) - 0.5) > 1e-6)
    tenths = F.rint(tenfold).cast("bigint")
    plain = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(clear, plain).otherwise(_exact_decimal(c))


def _exact_decimal(c: Column) -> Column:
    """``py_one_decimal`` of any number.

    Where the printed number lies midway between two results, the binary number itself decides:
    its exact distance from the midpoint is the rounding error of ``16x + 4x``.
    """
    decimal = c.try_cast("decimal(38,16)")
    twentieths = decimal * 20
    midway = (twentieths == F.floor(twentieths)) & (F.abs(F.floor(twentieths)) % 2 == 1)
    large, small = c * 16.0, c * 4.0
    total = large + small
    part = total - large
    error = (large - (total - part)) + (small - part)
    beyond = F.signum((total - F.rint(total)) + error)
    nudge = F.when(midway, beyond * 0.01).otherwise(0.0).cast("decimal(3,2)")
    rounded = F.bround(decimal + nudge, 1).try_cast("decimal(38,1)")
    return F.coalesce(rounded.cast("string"), F.format_string("%.1f", c))


def js_two_decimals(c: Column) -> Column:
    """``x.toFixed(2)`` for finite numbers: 1.005 gives 1.00, as the binary number is below 1.005.

    Where the printed number lies midway, the exact distance of ``200 x`` from the odd number decides, by the rounding
    errors of ``128 x + 64 x + 8 x``; a true midpoint goes away from zero.
    """
    decimal = c.try_cast("decimal(38,14)")
    halves = decimal * 200
    midway = (halves == F.floor(halves)) & (F.abs(F.floor(halves)) % 2 == 1)

    def add(a: Column, b: Column) -> tuple[Column, Column]:
        total = a + b
        part = total - a
        return total, (a - (total - part)) + (b - part)

    first, lost = add(c * 128.0, c * 64.0)
    total, more = add(first, c * 8.0)
    beyond = F.signum((total - F.rint(total)) + (lost + more))
    nudge = F.when(midway, beyond * 0.001).otherwise(0.0).cast("decimal(4,3)")
    return F.round(decimal + nudge, 2).try_cast("decimal(38,2)").cast("string")
