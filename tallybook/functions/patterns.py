"""The patterns, word lists and lookup tables of the invoice semantics, in the
order in which they are tried. English and German."""

# ---- basic extraction -------------------------------------------------------------------

INVOICE_NUMBER = [
    r"Invoice\s*(?:#\s*)?(?::\s*)?([A-Z0-9\-]+)",
    r"Invoice\s+Number\s*(?::\s*)?([A-Z0-9\-]+)",
    r"INV[-#]?(\d+)",
    r"#\s*(\d{4,})",
    r"Rechnung\s*(?:(?:Nr|Nummer|#)\s*)?(?::\s*)?([A-Z0-9\-]+)",
    r"Rechnungsnummer\s*(?::\s*)?([A-Z0-9\-]+)",
    r"Rechnungs-Nr\s*(?::\s*)?([A-Z0-9\-]+)",
    r"Rechnung\s+(?:#\s*)?(?::\s*)?([A-Z0-9\-]+)",
]

VENDOR_STOP_WORDS = ["invoice", "date", "bill to", "ship to", "rechnung", "datum", "kunde"]

# The buyer's name is the first line after one of these labels.
BUYER_NAME_LABELS = [
    r"Bill\s+To",
    r"Buyer",
    r"Customer",
    r"Kunde",
    r"Käufer",
    r"Rechnungsempfänger",
    r"An",
]

# The buyer's address is up to four lines after one of these.
BUYER_ADDRESS_LABELS = [
    r"Bill\s+To",
    r"Kunde",
    r"Rechnungsempfänger",
]
BUYER_ADDRESS_LINES = 4

# A street line has a digit and one of these words somewhere after it.
STREET_WORDS = [
    "street",
    "st",
    "avenue",
    "ave",
    "road",
    "rd",
    "drive",
    "dr",
    "lane",
    "ln",
    "way",
    "straße",
    "strasse",
    "weg",
    "platz",
    "allee",
]
ZIP_LINE = r"\d{5}(?:-\d{4})?"

INVOICE_DATE_LINE = [
    r"Invoice\s+Date\s*(?::\s*)?([^\n]+)",
    r"Date\s*(?::\s*)?([^\n]+)",
    r"Issued\s*(?::\s*)?([^\n]+)",
    r"Datum\s*(?::\s*)?([^\n]+)",
    r"Rechnungsdatum\s*(?::\s*)?([^\n]+)",
    r"Ausstellungsdatum\s*(?::\s*)?([^\n]+)",
]

DUE_DATE_LINE = [
    r"Due\s+Date\s*(?::\s*)?([^\n]+)",
    r"Payment\s+Due\s*(?::\s*)?([^\n]+)",
    r"Fälligkeitsdatum\s*(?::\s*)?([^\n]+)",
    r"Fällig\s+am\s*(?::\s*)?([^\n]+)",
    r"Zahlungsziel\s*(?::\s*)?([^\n]+)",
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

# Currency marks in the order they are looked for, with the code each stands for.
CURRENCY_MARKS = [
    ("$", "USD"),
    ("USD", "USD"),
    ("EUR", "EUR"),
    ("€", "EUR"),
    ("GBP", "GBP"),
    ("£", "GBP"),
    ("INR", "INR"),
    ("₹", "INR"),
]
DEFAULT_CURRENCY = "EUR"

TOTAL_AMOUNT = [
    r"Total\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"Total\s+Amount\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"Amount\s+Due\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"Grand\s+Total\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"Gesamtbetrag\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"Gesamtsumme\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"Endbetrag\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"Summe\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
]

SUBTOTAL = [
    r"Subtotal\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"Sub\s+Total\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"Zwischensumme\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
]

TAX_AMOUNT = [
    r"Tax\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"VAT\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"GST\s*(?::\s*)?(?:\$\s*)?([\d,]+\.?\d*)",
    r"MwSt\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"MwSt\.\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"Mehrwertsteuer\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"Umsatzsteuer\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"USt\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
    r"Steuer\s*(?::\s*)?(?:€\s*)?([\d,]+\.?\d*)",
]

# Payment terms: the pattern and the group that holds the value (0 is the whole match).
PAYMENT_TERMS = [
    (r"Payment\s+Terms\s*(?::\s*)?([^\n]+)", 1),
    (r"Terms\s*(?::\s*)?([^\n]+)", 1),
    (r"Net\s+\d+", 0),
    (r"Due\s+(?:on|in)\s+[^\n]+", 0),
    (r"Zahlungsbedingungen\s*(?::\s*)?([^\n]+)", 1),
    (r"Zahlungsziel\s*(?::\s*)?([^\n]+)", 1),
    (r"Zahlbar\s+bis\s*(?::\s*)?([^\n]+)", 1),
]

ITEM_HEADER_NAMES = ["description", "item", "product", "service", "beschreibung", "artikel", "position", "posten"]
ITEM_HEADER_VALUES = ["qty", "quantity", "price", "amount", "total", "menge", "preis", "betrag", "summe"]
ITEM_SECTION_ENDS = ["subtotal", "total", "tax", "payment", "zwischensumme", "gesamt", "steuer", "zahlung"]
ITEM_NUMBER = r"([\d,]+\.?\d*)"
ITEM_DESCRIPTION = r"^([A-Za-zÄÖÜäöüß\s\(\)\.\-]+)"

# ---- layout extraction ------------------------------------------------------------------

LAYOUT_VENDOR_STOP_WORDS = ["invoice", "bill", "date", "rechnung", "datum"]

LAYOUT_BUYER_LABELS = [
    "Bill To",
    "Ship To",
    "Sold To",
    "Customer",
    "Buyer",
    "Kunde",
    "Käufer",
    "Rechnungsempfänger",
    "An",
]
LAYOUT_BUYER_MARKS = ["To:", "An:", "Customer:"]

LAYOUT_INVOICE_NUMBER = [
    r"INV[-#]?(\d+)",
    r"#(\d{4,})",
    r"Invoice\s*(?:#\s*)?(?::\s*)?([A-Z0-9\-]+)",
    r"Invoice\s+Number\s*(?::\s*)?([A-Z0-9\-]+)",
    r"Rechnung(?:s)?(?:nummer|nr|#)?\s*(?::\s*)?([A-Z0-9\-]+)",
]

LAYOUT_INVOICE_DATE_LINE = [
    r"Invoice\s+Date\s*(?::\s*)?([^\n]+)",
    r"Date\s*(?::\s*)?([^\n]+)",
    r"Datum\s*(?::\s*)?([^\n]+)",
]

LAYOUT_DUE_DATE_LINE = [
    r"Due\s+Date\s*(?::\s*)?([^\n]+)",
    r"Payment\s+Due\s*(?::\s*)?([^\n]+)",
    r"Fälligkeitsdatum\s*(?::\s*)?([^\n]+)",
]

# Dates inside a line, with the groups that hold year, month and day.
LAYOUT_DATES = [
    (r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)),
    (r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1)),
    (r"(\d{2})-(\d{2})-(\d{4})", (3, 2, 1)),
    (r"(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{4})", (3, 2, 1)),
]

LAYOUT_TOTAL = [
    r"Total\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
    r"Total\s+Amount\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
    r"Gesamtbetrag\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
]

LAYOUT_SUBTOTAL = [
    r"Subtotal\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
    r"Zwischensumme\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
]

LAYOUT_TAX = [
    r"Tax\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
    r"VAT\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
    r"MwSt\.?\s*(?::\s*)?(?:[$€£₹]\s*)?([\d,]+\.?\d*)",
]

FALLBACK_VENDOR_STOP_WORDS = ["invoice", "bill", "date"]
FALLBACK_STREET = r"\d+\s+\w+\s+(?:street|st|avenue|ave|road)"
PLAIN_NUMBER = r"#(\d+)"

# ---- calendar ---------------------------------------------------------------------------

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = [
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

# ---- validation -------------------------------------------------------------------------

COMMON_CURRENCIES = ["USD", "EUR", "GBP", "INR", "CAD", "AUD", "JPY"]
