"""Column helpers against plain-Python statements of the same behaviour."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

from dateutil import parser
from pyspark.sql import functions as F

from tallybook.functions import normalize as N
from tallybook.functions import patterns as P
from tallybook.functions.dates import with_distinct_dates, with_parsed_date
from tallybook.functions.pycompat import py_float, py_float_text, py_one_decimal, pystrip
from tallybook.functions.similarity import similarities
from tallybook.operators import basic_extract as X
from tallybook.operators import layout_extract as L
from tallybook.plans import expected


def test_float_text(column):
    rng = random.Random(7)
    values = [0.0, -0.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.25e-4, 1e-5, 1.5e-7, -2.5e22]
    values += [float("inf"), float("-inf"), float("nan")]
    values += [round(rng.uniform(-1e9, 1e9), 2) for _ in range(300)]
    assert column(values, py_float_text, "double") == [str(v) for v in values]


def test_float_reading(column):
    texts = ["12.5", " 5 ", "1,2", "1e3", "1_000", "nan", "-Infinity", "inf", "1d", "1f", "", ".5", "5.", "--1", "0x1"]

    def read(text):
        try:
            return float(text)
        except ValueError:
            return None

    assert [str(v) for v in column(texts, py_float)] == [str(read(t)) for t in texts]


def test_one_decimal(column):
    rng = random.Random(5)
    values = [81.25, 81.75, 10.0, 0.05, 0.15, 0.25, 0.35, 0.45, 17.142857, 33.333333, 100.0, 0.0, 1e20, 2.675]
    values += [k / 20 for k in range(1, 400)] + [k / 20 for k in range(200001, 200100)]
    values += [rng.uniform(0, 200) for _ in range(200)] + [1 / n * 100 for n in range(1, 2500, 7)]
    assert column(values, py_one_decimal, "double") == [f"{v:.1f}" for v in values]


def test_strip(column):
    texts = ["  a 　", "\x1f\t b\x85", "", "  ", "c"]
    assert column(texts, pystrip) == [t.strip() for t in texts]


def test_normalize_text(column):
    texts = [" a \n\t b ", "", None, " x  y", "   "]
    assert column(texts, N.normalize_text) == ["a b", None, None, "x y", None]


def expected_date(text):
    s = text.strip()
    if re.match(r"^\d{4}-\d{2}-\d{2}$", s):
        return s
    formats = "%m/%d/%Y|%d/%m/%Y|%d-%m-%Y|%d.%m.%Y|%Y/%m/%d|%Y-%m-%d|%B %d, %Y|%B %d %Y|%d %B %Y|%d-%b-%Y|%d/%b/%Y|%d %b %Y|%b %d, %Y"
    for form in formats.split("|"):
        try:
            return dt.datetime.strptime(s, form).strftime("%Y-%m-%d")
        except ValueError:
            pass
    return s


def test_normalize_date(column):
    texts = ["2024-13-99", "05/04/2024", "13/04/2024", "31/04/2024", "5-4-2024", "15.03.2024", "2024/1/5", "2024-1-5"]
    texts += ["January 5, 2024", "january 05 2024", "5 March 2024", "05-Jan-2024", "5/feb/2024", "5 Sep 2024", "Oct 3, 2024"]
    texts += ["Oct 3 2024", "Sept 3, 2024", "5 Mai 2024", "1/2/24", "00/01/2024", "soon", " 2024-01-02 ", "May 5, 2024", "31 June 2024"]
    rng = random.Random(3)
    for _ in range(300):
        d, m, y = rng.randint(0, 33), rng.randint(0, 14), rng.randint(1990, 2030)
        sep = rng.choice("/-. ")
        texts.append(sep.join(map(str, rng.choice([(d, m, y), (y, m, d), (m, d, y)]))))
    assert column(texts, N.normalize_date) == [expected_date(t) for t in texts]
    once = column(texts, N.normalize_date)
    assert column(once, N.normalize_date) == once


def expected_amount(text):
    kept = re.sub(r"[^\d.\-]", "", re.sub(r"[$€₹£¥₨]*", "", text.strip()).replace(",", ""))
    try:
        float(kept)
        return kept
    except ValueError:
        return None


def test_normalize_amount(column):
    texts = ["$1,234.56", "1.234,56", "€ 5", "-3", "3-", "n/a", "USD 12 .5", "..", ".5", "5.", "--5", "₹ 1,00,000"]
    assert column(texts, N.normalize_amount) == [expected_amount(t) for t in texts]
    assert column(["", None], N.normalize_amount) == [None, None]


def test_normalize_gst(column):
    assert column(["29abcde 1234f-1z5", "x", "--", None], N.normalize_gst) == ["29ABCDE1234F1Z5", "X", None, None]


def test_captured_amounts(column):
    texts = ["1234.56", "1,234.56", "1,234,567.89", "1.234", "1234,56", "1,080", "80.00", ",", "1,,2.5"]
    legacy = [123456.0, None, 1.234, 1234.0, 123456.0, 1080.0, 8000.0, None, 1.0]
    plain = [1234.56, 1234.56, 1234567.89, 1.234, 123456.0, 1080.0, 80.0, None, 12.5]
    assert column(texts, N.parse_amount_basic) == legacy
    assert column(texts, N.parse_amount_normalized) == plain


def test_layout_dates(column):
    texts = ["on 2024-13-99 x", "05/04/2024", "05-04-2024", "5 March 2024", "12 okt 2024", "none"]
    assert column(texts, N.to_layout_date) == ["2024-13-99", "2024-04-05", "2024-04-05", "2024-03-05", None, None]


def test_currency(column):
    texts = ["INR 5 and $", "EUR 5", "£ 5 ₹", "5", "usd"]
    assert column(texts, N.currency_basic) == ["USD", "EUR", "GBP", "EUR", "EUR"]
    assert column(texts, N.currency_layout) == ["USD", "EUR", None, None, None]


def test_lenient_dates(spark):
    as_of = dt.datetime(2024, 12, 31)
    texts = ["05/04/2024", "13/04/2024", "05-04-2024", "05.04.2024", "15.03.2024", "20240115", "Jan 5, 2024", "March"]
    texts += ["2024", "15", "2024-01-15T10:00:00Z", "2024-01-15T23:30:00-05:00", "2024-01-15 10:00", "12 März 2024"]
    texts += ["5 Oktober 2024", "Net 30", "2024-02-30", "2024-13-01", "   ", "due on receipt", "9" * 20, "Monday", "at noon"]
    texts += ["15-Jan-2024", "3rd of May 2001", "13/13/2024", "2024/5/6", "1.2.2024", "May 5 2024", "not a date", "soon", "a.m."]
    rng = random.Random(11)
    for _ in range(300):
        d, m, y = rng.randint(0, 33), rng.randint(0, 14), rng.choice([rng.randint(1900, 2100), rng.randint(32, 99)])
        sep = rng.choice("/-. ")
        texts.append(sep.join(map(str, rng.choice([(d, m, y), (y, m, d), (m, d, y)]))))
    for _ in range(150):
        name = rng.choice(P.MONTHS + P.MONTH_NAMES).title()
        form = rng.choice(["{d} {n} {y}", "{n} {d}, {y}", "{n} {d} {y}", "{d}-{n}-{y}", "{y} {n} {d}"])
        texts.append(form.format(d=rng.randint(0, 32), n=name, y=rng.randint(1990, 2030)))

    def expected(text):
        try:
            value = parser.parse(text, default=as_of)
            zoned = value.tzinfo is not None
            if zoned:
                value = (value - value.utcoffset()).replace(tzinfo=None)
        except (ValueError, TypeError, OverflowError):
            return None
        midnight = dt.datetime.combine(value.date(), dt.time())
        return value.date(), (value - midnight) // dt.timedelta(microseconds=1), zoned

    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    rows = with_parsed_date(df, "p", "v", F.lit("2024-12-31").cast("date")).orderBy("i").select("p.*").collect()
    got = [None if r.day is None else (r.day, r.tod, r.zoned) for r in rows]
    assert dict(zip(texts, got)) == {t: expected(t) for t in texts}


def test_similarity(spark):
    pairs = [("acme corp", "Acme Corporation"), ("ab", "ba"), ("tide", "diet"), ("diet", "tide"), ("Same", "sAME")]
    pairs += [("x" * 150 + "ab" * 60, "ab" * 120 + "y"), ("a", " "), (None, "a")]
    schema = "i int, p array<struct<left:string,right:string>>"
    df = spark.createDataFrame([(i, [pair, pair]) for i, pair in enumerate(pairs)], schema)
    rows = df.orderBy("i").select(similarities(F.col("p"))).collect()

    def ratio(a, b):
        if a is None or not b.strip() or a.lower() == b.lower():
            return None
        return SequenceMatcher(None, a.lower(), b.lower()).ratio()

    assert [r[0] for r in rows] == [[ratio(*p)] * 2 for p in pairs]
    assert rows[2][0][0] == 0.25 and rows[3][0][0] == 0.5


def first_match(text, patterns, group=1):
    for p in patterns:
        found = re.search(p, text, re.IGNORECASE)
        if found:
            return found.group(group).strip()
    return None


TRICKY = [
    "Invoice Number: INV-2024-001\nSubtotal: $1,000.00\nTotal: $1,080.00\nTax 10%: 80",
    "RECHNUNG NR: R-7\nKÄUFER:\n  Jörg Ümlaut \nFÄLLIG AM 3 März 2024\nMWST.: € 12",
    "Bill To:\n\n   \n  Late Name\nStreet 5\n",
    "Bill To:\n \t",
    "An:\nAlpha\nTo:\nBeta",
    "Due Date: none\nPayment Due: 2024-01-05\nDate: 3 May 2024",
    "Sold To : \nNon Breaking\n",
    "inv#77 INV12345 #9876",
    "line one\r\nCustomer:\r\nCarriage Return\r\nNet  45",
    "Terms: within 10 days\nDue in 5 days",
    "",
    "totAL 5,00 Gesamtbetrag: €7.5",
]


def test_patterns_match_python(column):
    from tallybook.functions.pycompat import first_capture

    assert column(TRICKY, X.buyer_name) == [first_match(t, expected.BUYER_NAME) for t in TRICKY]
    assert column(TRICKY, X.buyer_address) == [first_match(t, expected.BUYER_ADDRESS) for t in TRICKY]
    lists = [P.INVOICE_NUMBER, P.INVOICE_DATE_LINE, P.DUE_DATE_LINE, P.TOTAL_AMOUNT]
    lists += [P.SUBTOTAL, P.TAX_AMOUNT, P.LAYOUT_INVOICE_NUMBER, P.LAYOUT_TOTAL, P.LAYOUT_TAX]
    for patterns in lists:
        got = column(TRICKY, lambda c, ps=patterns: pystrip(first_capture(c, ps)))
        assert got == [first_match(t, patterns) for t in TRICKY]


def test_number_traps(column):
    text = ["Invoice Number: INV-2024-001", "Invoice # 12", "RE 12"]
    assert column(text, X.invoice_number) == ["Number", "12", None]
    assert column(text, L.number_layout) == ["2024", None, None]


def test_total_inside_subtotal(column):
    text = ["Subtotal: $1,000.00\nTotal: $1,080.00"]
    assert column(text, lambda c: X.amount(c, P.TOTAL_AMOUNT, "normalized")) == [1000.0]
    assert column(text, lambda c: X.amount(c, P.TOTAL_AMOUNT, "normalized", "(?<!sub)")) == [1080.0]


def test_vendor_address(column):
    texts = [
        "Acme\n12 Harbor Street\n12345-6789 Springfield\n99 Later Road",
        "No address here",
        "5 straße 9\n77777 weg\nx\n1 st",
        "Way 5\n12345",
        "\n".join(["x"] * 15 + ["1 Road"]),
    ]
    want = ["12 Harbor Street 12345-6789 Springfield", None, "5 straße 9 77777 weg 1 st", "12345", None]
    assert column(texts, lambda c: X.vendor_address(X.lines_of(c))) == want


def expected_items(text):
    out, inside = [], False
    name = "description|item|product|service|beschreibung|artikel|position|posten"
    value = "qty|quantity|price|amount|total|menge|preis|betrag|summe"
    end = "subtotal|total|tax|payment|zwischensumme|gesamt|steuer|zahlung"
    for line in text.split("\n"):
        low = line.lower()
        if re.search(name, low) and re.search(value, low):
            inside = True
        elif inside:
            if re.search(end, low):
                return out
            numbers = re.findall(r"[\d,]+\.?\d*", line)
            lead = re.match(r"[A-Za-zÄÖÜäöüß\s().\-]+", line)
            cleaned = [n.replace(",", "").replace(".", "") for n in numbers]
            if len(numbers) >= 2 and lead and all(cleaned):
                v = [float(n) for n in cleaned]
                out.append((lead.group().strip(), v[0], v[1] if len(v) > 2 else None, v[2] if len(v) > 2 else v[1]))
    return out


def test_line_items(column):
    texts = [
        "Description Qty Price Total\nWidget 2 10.50 21.00\nGadget 1 5\n  3 4 5\n7up 1 2\nBolt (x) 1,000 2 3 4\nTotal 9\nLate 1 2",
        "Widget 1 2\nItem Amount\nItem total 5 6\nNut , 5 6\nNut 5 , 6\nTax 1 2\n",
        "Artikel Menge\nSchräubchen 3 4\nZwischensumme 5",
        "no table 1 2 3",
        "",
        "Item Price",
    ]
    got = column(texts, X.line_items)
    assert [[tuple(i) for i in items] for items in got] == [expected_items(t) for t in texts]


def test_distinct_dates_are_read_alike(spark):
    texts = ["March", "20th of January 2024", "2024-01-05", "soon", "", None, "Tue 3 Mar 2020", "no day in May 1999"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    as_of = F.lit("2023-02-28").cast("date")
    once = with_distinct_dates(df, "d", "t", as_of)
    assert once.columns == ["i", "t", "d"]
    assert sorted(map(str, once.collect())) == sorted(map(str, with_parsed_date(df, "d", "t", as_of).collect()))
    days = {r.t: r.d.day for r in once.collect()}
    assert str(days["March"]) == "2023-03-28" and str(days["20th of January 2024"]) == "2024-01-20" and days["soon"] is None
