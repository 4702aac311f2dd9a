"""The patterns of the invoice semantics in their plain form, as DuckDB reads them.

The SQL counterparts use these and not the tables of the library, which are written for another engine and are what the
SQL is there to check.
"""

NUMBER = r"\s*:?\s*([A-Z0-9\-]+)"
LINE = r"\s*:?\s*([^\n]+)"
NEXT_LINE = r"\s*:?\s*\n\s*([^\n]+)"
NEXT_LINES = r"\s*:?\s*\n((?:[^\n]+\n){1,4})"
DOLLARS = r"\s*:?\s*\$?\s*([\d,]+\.?\d*)"
EUROS = r"\s*:?\s*€?\s*([\d,]+\.?\d*)"
MONEY = r"\s*:?\s*[$€£₹]?\s*([\d,]+\.?\d*)"

INVOICE_NUMBER = [
    r"Invoice\s*#?" + NUMBER,
    r"Invoice\s+Number" + NUMBER,
    r"INV[-#]?(\d+)",
    r"#\s*(\d{4,})",
    r"Rechnung\s*(?:Nr|Nummer|#)?" + NUMBER,
    r"Rechnungsnummer" + NUMBER,
    r"Rechnungs-Nr" + NUMBER,
    r"Rechnung\s+#?" + NUMBER,
]
BUYER_LABELS = [r"Bill\s+To", "Buyer", "Customer", "Kunde", "Käufer", "Rechnungsempfänger", "An"]
BUYER_NAME = [label + NEXT_LINE for label in BUYER_LABELS]
BUYER_ADDRESS = [label + NEXT_LINES for label in (r"Bill\s+To", "Kunde", "Rechnungsempfänger")]
INVOICE_DATE_LINE = [
    label + LINE for label in (r"Invoice\s+Date", "Date", "Issued", "Datum", "Rechnungsdatum", "Ausstellungsdatum")
]
DUE_DATE_LINE = [
    label + LINE for label in (r"Due\s+Date", r"Payment\s+Due", "Fälligkeitsdatum", r"Fällig\s+am", "Zahlungsziel")
]
DATE_IN_LINE = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}",
    r"\d{1,2}\.\d{1,2}\.\d{4}",
    r"\d{1,2}\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)[a-z]*\s+\d{4}",
    r"\d{1,2}\s+(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)[a-z]*\s+\d{4}",
]
TOTAL_AMOUNT = [label + DOLLARS for label in ("Total", r"Total\s+Amount", r"Amount\s+Due", r"Grand\s+Total")] + [
    label + EUROS for label in ("Gesamtbetrag", "Gesamtsumme", "Endbetrag", "Summe")
]
SUBTOTAL = ["Subtotal" + DOLLARS, r"Sub\s+Total" + DOLLARS, "Zwischensumme" + EUROS]
TAX_AMOUNT = [label + DOLLARS for label in ("Tax", "VAT", "GST")] + [
    label + EUROS for label in ("MwSt", r"MwSt\.", "Mehrwertsteuer", "Umsatzsteuer", "USt", "Steuer")
]
PAYMENT_TERMS = [
    (r"Payment\s+Terms" + LINE, 1),
    ("Terms" + LINE, 1),
    (r"Net\s+\d+", 0),
    (r"Due\s+(?:on|in)\s+[^\n]+", 0),
    ("Zahlungsbedingungen" + LINE, 1),
    ("Zahlungsziel" + LINE, 1),
    (r"Zahlbar\s+bis" + LINE, 1),
]
CURRENCY_MARKS = [
    ("$", "USD"), ("USD", "USD"), ("EUR", "EUR"), ("€", "EUR"), ("GBP", "GBP"), ("£", "GBP"), ("INR", "INR"), ("₹", "INR"),
]
VENDOR_STOP_WORDS = "invoice|date|bill to|ship to|rechnung|datum|kunde".split("|")
STREET_WORDS = "street st avenue ave road rd drive dr lane ln way straße strasse weg platz allee".split()
ZIP_LINE = r"\d{5}(?:-\d{4})?"
ITEM_HEADER_NAMES = "description item product service beschreibung artikel position posten".split()
ITEM_HEADER_VALUES = "qty quantity price amount total menge preis betrag summe".split()
ITEM_SECTION_ENDS = "subtotal total tax payment zwischensumme gesamt steuer zahlung".split()
ITEM_NUMBER = r"([\d,]+\.?\d*)"
ITEM_DESCRIPTION = r"^([A-Za-zÄÖÜäöüß\s\(\)\.\-]+)"
LAYOUT_VENDOR_STOP_WORDS = "invoice bill date rechnung datum".split()
LAYOUT_BUYER_LABELS = [
    "Bill To", "Ship To", "Sold To", "Customer", "Buyer", "Kunde", "Käufer", "Rechnungsempfänger", "An",
]
LAYOUT_BUYER_MARKS = ["To:", "An:", "Customer:"]
LAYOUT_INVOICE_NUMBER = [
    r"INV[-#]?(\d+)",
    r"#(\d{4,})",
    r"Invoice\s*#?" + NUMBER,
    r"Invoice\s+Number" + NUMBER,
    r"Rechnung(?:s)?(?:nummer|nr|#)?" + NUMBER,
]
LAYOUT_INVOICE_DATE_LINE = [label + LINE for label in (r"Invoice\s+Date", "Date", "Datum")]
LAYOUT_DUE_DATE_LINE = [label + LINE for label in (r"Due\s+Date", r"Payment\s+Due", "Fälligkeitsdatum")]
LAYOUT_DATES = [
    (r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)),
    (r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1)),
    (r"(\d{2})-(\d{2})-(\d{4})", (3, 2, 1)),
    (r"(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{4})", (3, 2, 1)),
]
LAYOUT_TOTAL = [label + MONEY for label in ("Total", r"Total\s+Amount", "Gesamtbetrag")]
LAYOUT_SUBTOTAL = [label + MONEY for label in ("Subtotal", "Zwischensumme")]
LAYOUT_TAX = [label + MONEY for label in ("Tax", "VAT", r"MwSt\.?")]
FALLBACK_VENDOR_STOP_WORDS = "invoice bill date".split()
FALLBACK_STREET = r"\d+\s+\w+\s+(?:street|st|avenue|ave|road)"
PLAIN_NUMBER = r"#(\d+)"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
