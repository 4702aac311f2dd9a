"""Patterns read long runs of blanks in one go and accept what their plain forms accept."""

import random
import re
import time

from pyspark.sql import functions as F

from tallybook.functions import patterns as P
from tallybook.functions.pycompat import capture, fold, js_two_decimals, line_after, lines_after, pystrip, regex
from tallybook.operators.basic_extract import amount, buyer_address, buyer_name
from tallybook.operators.layout_extract import amount_layout, buyer_layout, fallback_buyer


def all_patterns():
    for value in vars(P).values():
        if isinstance(value, list):
            for entry in value:
                yield entry[0] if isinstance(entry, tuple) else entry


def plain(pattern):
    """The form in which each optional sign stands between blanks of its own."""
    pattern = pattern.replace(r"\s*(?:(?:Nr|Nummer|#)\s*)?", r"\s*(?:Nr|Nummer|#)?\s*")
    pattern = re.sub(r"\(\?:(#|:|\\\$|€|\[[$€£₹]+\])\\s\*\)\?", r"\1?\\s*", pattern)
    return pattern


def test_same_texts():
    rng = random.Random(1)
    changed = [p for p in all_patterns() if isinstance(p, str) and "(?::" in p]
    assert len(changed) > 40
    for p in changed:
        old, new = re.compile(plain(p), re.I), re.compile(p, re.I)
        assert plain(p) != p
        label = re.sub(r"\(\?:[^()]*\)\??", "", re.split(r"\\s[*]?\(", p)[0]).replace(r"\s+", " ").replace("\\", "")
        for _ in range(300):
            text = "".join(rng.choice([label, " ", "  ", "\n", ":", "#", "$", "€", "7", "A-1", ",", "Nr", "x"]) for _ in range(9))
            a, b = old.search(text), new.search(text)
            assert (a and a.groups()) == (b and b.groups()), (p, text)


def test_long_blanks_and_lines(column):
    line, blanks = "ab 12 " * 14_000, "Invoice" + " " * 5000 + ".\nTotal" + " " * 5000 + "x"
    column(["x"], fallback_buyer)
    start = time.perf_counter()
    assert column([line], fallback_buyer) == [None]
    number, total = r"Invoice\s*(?:#\s*)?(?::\s*)?([A-Z0-9\-]+)", r"Total\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)"
    assert {number, total} <= set(all_patterns())
    assert column([blanks], lambda c: F.regexp_extract(c, number, 1)) == [""]
    assert column([blanks], lambda c: F.regexp_extract(c, total, 1)) == [""]
    assert time.perf_counter() - start < 10


def test_lines_after_a_label(column):
    """The possessive forms take what the plain ones take, whatever blanks, colons and line feeds come together."""
    rng = random.Random(7)
    parts = ["An", "an", " ", "  ", "\n", "\n", ":", "x y", "\t", "\x1c", "b:", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    for linear, form in (
        (line_after("An"), r"An\s*:?\s*\n\s*([^\n]+)"),
        (lines_after("An", 4), r"An\s*:?\s*\n((?:[^\n]+\n){1,4})"),
    ):
        got = column(texts, lambda c, linear=linear: pystrip(capture(c, linear)))
        for text, found in zip(texts, got, strict=True):
            want = re.search(form, text, re.I)
            assert found == (want and want.group(1).strip()), (form, text)
        assert sum(f is not None for f in got) > 500


def test_guards_change_nothing(column):
    rng = random.Random(8)
    labels = ["Invoice", "İnvoıce", "BILL TO", "ſumme", "\u212aunde", "Käufer", "KÄUFER", "Fällig am", "STEUER", "Net", "#", "inv-"]
    texts = ["".join(rng.choice([*labels, " ", ": ", "\n", "1234", "x", "$5"]) for _ in range(10)) for _ in range(800)]
    for patterns in (P.INVOICE_NUMBER, P.TOTAL_AMOUNT, P.TAX_AMOUNT, [p for p, _ in P.PAYMENT_TERMS], [line_after(w) for w in P.BUYER_NAME_LABELS]):
        for pattern in patterns:
            group = 0 if "(" not in pattern.replace("(?:", "") else 1
            bare = column(texts, lambda c, p=pattern, g=group: capture(c, p, g))
            assert column(texts, lambda c, p=pattern, g=group: capture(c, p, g, folded=fold(c))) == bare, pattern


def test_hostile_white_space_is_read_once(column):
    blanks, feeds, mixed = " " * 5000, "\n" * 5000, " \n" * 2500
    readers = [
        lambda c: buyer_name(c), lambda c: buyer_address(c), buyer_layout, lambda c: amount_layout(c, P.LAYOUT_TOTAL),
        lambda c: amount_layout(c, P.LAYOUT_TAX), lambda c: amount_layout(c, P.LAYOUT_SUBTOTAL), lambda c: amount(c, P.TOTAL_AMOUNT),
    ]
    for read in readers:
        column(["warm"], read)
        for run in (blanks, feeds, mixed):
            for label in ("Bill To", "Customer:", "Total", "Subtotal", "Tax:", "MwSt", "To:"):
                start = time.perf_counter()
                column([label + run + ".", label + run, label + run + ":" + run], read)
                assert time.perf_counter() - start < 1.5, (label, run[:2])


def test_every_pattern_has_a_text(spark, data):
    """Each pattern of the basic extraction is the first to match some text of F12."""
    from tallybook.sources import derived

    texts = [r.text for r in derived.label_texts(spark, data).collect()]
    next_line, next_lines = r"\s*:?\s*\n\s*([^\n]+)", r"\s*:?\s*\n((?:[^\n]+\n){1,4})"
    tables = {
        "number": P.INVOICE_NUMBER, "name": [w + next_line for w in P.BUYER_NAME_LABELS],
        "address": [w + next_lines for w in P.BUYER_ADDRESS_LABELS], "date": P.INVOICE_DATE_LINE, "due": P.DUE_DATE_LINE,
        "total": P.TOTAL_AMOUNT, "subtotal": P.SUBTOTAL, "tax": P.TAX_AMOUNT, "terms": [p for p, _ in P.PAYMENT_TERMS],
        "layout buyer": [re.escape(w) + next_line for w in P.LAYOUT_BUYER_LABELS], "layout number": P.LAYOUT_INVOICE_NUMBER,
        "layout date": P.LAYOUT_INVOICE_DATE_LINE, "layout due": P.LAYOUT_DUE_DATE_LINE, "layout total": P.LAYOUT_TOTAL,
        "layout subtotal": P.LAYOUT_SUBTOTAL, "layout tax": P.LAYOUT_TAX,
    }
    for name, patterns in tables.items():
        first = {next((i for i, p in enumerate(patterns) if re.search(p, t, re.I)), None) for t in texts}
        # What an earlier pattern always matches as well can never be first.
        never = set(range(len(patterns))) - first
        for i in never:
            assert any(re.search(p, t, re.I) for t in texts for p in patterns[:i] if re.search(patterns[i], t, re.I)), (name, patterns[i])


def test_fallback_buyer_takes_its_line(column):
    texts = ["x\nAcme Corp 12 Main Street\ny", "no address", None, "ab 12 Main Street"]
    old = column(texts, lambda c: F.regexp_extract(c, regex(r"([^\n]*?)" + P.FALLBACK_STREET), 1))
    got = column(texts, fallback_buyer)
    want = [o.strip() if o and len(o.strip()) > 3 else None for o in old]
    assert got == want


def test_two_decimals_as_in_a_browser(column):
    values = [1.005, 2.675, 0.125, -0.125, 1.0, 1234.5, 0.0, 8.345, 1.45, 10.235, None]
    want = ["1.00", "2.67", "0.13", "-0.13", "1.00", "1234.50", "0.00", "8.35", "1.45", "10.23", None]
    assert column(values, js_two_decimals, "double") == want
