"""Invoice-shaped inputs derived from the order tables (see FIXTURES.md).

Every table here is a plain Spark job over whole input tables. Items stay a child table whose
sums and counts are pre-aggregated per invoice, so a hot order never becomes one huge array.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources.tables import spread, table

def _every(key: Column, n: int) -> Column:
    return key % n == 0


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Item sum, item count and first supplier per order."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).alias("st"),
            F.count(F.lit(1)).alias("item_count"),
            F.min("l_suppkey").alias("sk"),
        )
    )


def order_sides(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What orders are joined with to make invoices of them, by the column it is joined on."""
    return {
        "k": order_totals(spark, folder),
        "c_custkey": table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"),
        "n_nationkey": table(spark, folder, "nation").select("n_nationkey", "n_regionkey"),
        "s_suppkey": table(spark, folder, "supplier").select("s_suppkey", "s_name"),
    }


def invoices_from_orders(
    orders: DataFrame, spark: SparkSession, folder: str, sides: dict[str, DataFrame] | None = None
) -> DataFrame:
    """F1 for the given orders: one invoice per order, with seeded defects.

    ``orders`` may be a stream; everything it is joined with is static. A stream reads ``sides`` anew for every
    batch: hand it written ones.
    """
    k = F.col("k")
    sides = sides or order_sides(spark, folder)
    base = (
        orders.select(
            F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_custkey")
        )
        .join(sides["k"], "k", "left")
        .join(sides["c_custkey"], F.col("c_custkey") == F.col("o_custkey"))
        .join(sides["n_nationkey"], F.col("n_nationkey") == F.col("c_nationkey"))
        .join(sides["s_suppkey"], F.col("s_suppkey") == F.col("sk"), "left")
    )
    st = F.col("st")
    region_currency = (
        F.when(F.col("n_regionkey") == 0, "USD")
        .when(F.col("n_regionkey") == 1, "EUR")
        .when(F.col("n_regionkey") == 2, "JPY")
        .when(F.col("n_regionkey") == 3, "GBP")
        .otherwise("INR")
    )
    named = base.select(
        k.alias("invoice_id"),
        "d",
        F.when(_every(k, 31), "A1")
        .when(_every(k, 29), _null())
        .otherwise(F.concat(F.lit("INV-"), F.lpad(k.cast("string"), 8, "0")))
        .alias("invoice_number"),
        F.col("s_name").alias("vendor_name"),
        F.when(_every(k, 37), _null())
        .when(_every(k, 41), F.upper("s_name"))
        .otherwise(F.col("c_name"))
        .alias("buyer_name"),
        F.when(_every(k, 43), "not a date")
        .when(_every(k, 47), "")
        .otherwise(F.col("d").cast("string"))
        .alias("invoice_date"),
        F.when(_every(k, 13), _null())
        .when(_every(k, 53), F.date_sub("d", 10).cast("string"))
        .when(_every(k, 59), F.date_add("d", 400).cast("string"))
        .when(_every(k, 61), "soon")
        .otherwise(F.date_add("d", 30).cast("string"))
        .alias("due_date"),
        F.when(_every(k, 17), _null()).when(_every(k, 19), "CHF").otherwise(region_currency).alias("currency"),
        F.when(_every(k, 67), st + 5).otherwise(st).cast("decimal(18,2)").alias("sub"),
        F.when(_every(k, 71), _null("decimal(18,2)"))
        .otherwise(F.round(st * F.lit(Decimal("0.08")), 2).cast("decimal(18,2)"))
        .alias("tax"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        st.cast("double").alias("items_total"),
    )
    key, gross = F.col("invoice_id"), F.col("sub") + F.coalesce("tax", F.lit(0))
    total = (
        F.when(_every(key, 73), F.lit(0))
        .when(_every(key, 79), -gross)
        .when(_every(key, 89), gross * 1000)
        .when(_every(key, 83), gross * 50)
        .when(_every(key, 23), gross + 1)
        .otherwise(gross)
    )
    return named.select(
        "invoice_id",
        "d",
        "invoice_number",
        "vendor_name",
        "buyer_name",
        _null().alias("vendor_address"),
        _null().alias("buyer_address"),
        "invoice_date",
        "due_date",
        "currency",
        F.col("sub").cast("double").alias("subtotal"),
        F.col("tax").cast("double").alias("tax_amount"),
        total.cast("double").alias("total_amount"),
        _null().alias("payment_terms"),
        "item_count",
        "items_total",
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """one invoice per order, with seeded defects."""
    return invoices_from_orders(spread(table(spark, folder, "orders")), spark, folder)


def _money(c: Column) -> Column:
    return F.coalesce(c.cast("decimal(18,2)").cast("string"), F.lit(""))


def invoice_text(invoices: DataFrame) -> DataFrame:
    """invoices rendered as text in four layouts, by ``invoice_id % 4``."""
    layout = F.col("invoice_id") % 4
    german = layout == 2
    newline = F.lit("\n")
    date = F.col("invoice_date")
    dotted = F.concat(F.substring(date, 9, 2), F.lit("."), F.substring(date, 6, 2), F.lit("."), F.substring(date, 1, 4))
    parts = [
        F.coalesce("vendor_name", F.lit("Unknown Trading")),
        F.lit("\n12 Harbor Street\n12345 Springfield\n"),
        F.when(layout == 0, "Invoice #: ")
        .when(layout == 1, "Invoice Number: ")
        .when(german, "Rechnungsnummer: ")
        .otherwise("Ref #"),
        F.coalesce("invoice_number", F.lit("")),
        newline,
        F.when(german, "Rechnungsdatum: ").otherwise("Invoice Date: "),
        F.when(german & (F.length(date) == 10) & (date != "not a date"), dotted).otherwise(F.coalesce(date, F.lit(""))),
        newline,
        F.when(F.col("due_date").isNull(), "").otherwise(
            F.concat(F.when(german, "Fälligkeitsdatum: ").otherwise("Due Date: "), F.col("due_date"), newline)
        ),
        F.when(F.col("buyer_name").isNull(), "").otherwise(
            F.concat(
                F.when(german, "Kunde:").otherwise("Bill To:"),
                newline,
                F.col("buyer_name"),
                F.lit("\n1 Road\n\n"),
            )
        ),
        F.when(layout == 1, F.concat(F.lit("Total: $"), _money(F.col("total_amount")), newline)).otherwise(""),
        F.when(german, "Zwischensumme: €").otherwise("Subtotal: $"),
        F.when(layout == 3, F.coalesce(F.floor("subtotal").cast("string"), F.lit(""))).otherwise(
            _money(F.col("subtotal"))
        ),
        newline,
        F.when(german, "MwSt: €").otherwise("Tax: $"),
        _money(F.col("tax_amount")),
        newline,
        F.when(german, "Gesamtbetrag: €").when(layout == 1, "Amount Due: $").otherwise("Total: $"),
        _money(F.col("total_amount")),
        F.lit("\nNet 30\n"),
    ]
    return invoices.select("invoice_id", F.concat(*parts).alias("text"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return invoice_text(invoices(spark, folder))


#: A task makes the words of about so many texts: some 20 rows each, which are then put in reading order.
TEXTS_PER_TASK = 50_000


def in_small_parts(texts: DataFrame, folder: str) -> DataFrame:
    """The texts of all orders dealt by their id, in a number of parts that grows with the orders.

    Adaptive execution sizes the partitions of a join by the rows that go in; of texts that become many rows each it
    would leave millions to a task.
    """
    spark = texts.sparkSession
    # Parquet footers have this number: no column is read.
    n_texts = table(spark, folder, "orders").count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n_texts // TEXTS_PER_TASK))
    return texts.repartition(parts, "invoice_id")


def words(texts: DataFrame) -> DataFrame:
    """word boxes of the rendered text, with a second page for even ids."""
    lines = texts.select("invoice_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    parts = lines.select("invoice_id", "line", F.posexplode(F.split("line_text", " ")).alias("pos", "text"))
    pages = F.when(_every(F.col("invoice_id"), 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    y, x = F.col("line") * 14.0, F.col("pos") * 50.0
    return (
        parts.filter(F.col("text") != "")
        .withColumn("page", F.explode(pages))
        .select(
            "invoice_id",
            (F.col("page") * 1_000_000 + F.col("line") * 1000 + F.col("pos")).alias("ord"),
            "page",
            "text",
            x.alias("x0"),
            y.alias("y0"),
            (x + 40.0).alias("x1"),
            (y + 10.0).alias("y1"),
        )
    )


def pages(texts: DataFrame) -> DataFrame:
    """F3b: the rendered text split in two pages at the first buyer label."""
    bill, kunde = F.instr("text", "Bill To"), F.instr("text", "Kunde")
    cut = F.when(bill > 0, bill).when(kunde > 0, kunde).otherwise(F.length("text") + 1)
    both = F.array(
        F.struct(F.lit(0).alias("page"), F.substr("text", F.lit(1), cut - 1).alias("text")),
        F.struct(F.lit(1).alias("page"), F.substr("text", cut).alias("text")),
    )
    return texts.select("invoice_id", F.inline(both))


def responses(invoices: DataFrame) -> DataFrame:
    """invoices as model responses: bare, fenced, inside prose, or broken JSON."""
    body = F.to_json(
        F.struct(
            "invoice_number",
            "vendor_name",
            "buyer_name",
            "invoice_date",
            "due_date",
            "currency",
            F.col("subtotal").cast("decimal(18,2)").cast("string").alias("subtotal"),
            F.col("tax_amount").cast("decimal(18,2)").cast("string").alias("tax_amount"),
            F.col("total_amount").cast("decimal(18,2)").cast("string").alias("total_amount"),
        )
    )
    shape = F.col("invoice_id") % 4
    response = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .otherwise(F.concat(F.lit("{"), body))
    )
    return invoices.select("invoice_id", response.alias("response"))


def gst_responses(invoices: DataFrame) -> DataFrame:
    """GST-shaped responses with untidy values, for the normalisers behind the response parser."""
    key, date = F.col("invoice_id"), F.col("d")
    untidy_date = (
        F.when(key % 3 == 0, F.date_format("d", "MM/dd/yyyy"))
        .when(key % 3 == 1, F.date_format("d", "dd.MM.yyyy"))
        .otherwise(date.cast("string"))
    )
    amount = F.col("total_amount").cast("decimal(18,2)").cast("string")
    item = F.struct(
        F.concat(F.lit(" Order  lines "), key.cast("string")).alias("description"),
        F.col("item_count").cast("string").alias("quantity"),
        F.concat(F.lit("$"), F.col("subtotal").cast("decimal(18,2)").cast("string")).alias("amount"),
    )
    body = F.to_json(
        F.struct(
            F.concat(F.lit("  "), F.col("vendor_name"), F.lit("  Ltd ")).alias("supplier_name"),
            F.concat(F.lit("29abcde "), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("f-1z5")).alias("supplier_gst"),
            F.col("buyer_name").alias("customer_name"),
            "invoice_number",
            untidy_date.alias("invoice_date"),
            F.col("due_date"),
            F.concat(F.lit("€ "), amount).alias("total_amount"),
            F.when(F.col("item_count") > 0, F.array(item)).alias("items"),
        )
    )
    return invoices.select("invoice_id", F.concat(F.lit("Result:\n"), body).alias("response"))


def second_source(invoices: DataFrame) -> DataFrame:
    """a second extraction of the same invoices that differs in known places."""
    key = F.col("invoice_id")
    changed = {
        "vendor_name": F.when(_every(key, 12), "Northwind Traders")
        .when(_every(key, 5), F.upper("vendor_name"))
        .otherwise(F.col("vendor_name")),
        "buyer_name": F.when(_every(key, 11), _null()).otherwise(F.col("buyer_name")),
        "total_amount": F.when(_every(key, 7), F.col("total_amount") * 1.10)
        .when(_every(key, 9), F.col("total_amount") * 1.04)
        .otherwise(F.col("total_amount")),
        "item_count": F.when(_every(key, 6), F.greatest(F.col("item_count") - 1, F.lit(0))).otherwise(
            F.col("item_count")
        ),
    }
    return invoices.withColumns(changed)


def entities(invoices: DataFrame) -> DataFrame:
    """document-service entities, some below the confidence limit, some repeated."""
    named = {
        "vendor_name": F.col("vendor_name"),
        "buyer_name": F.concat(F.lit(" "), F.col("buyer_name"), F.lit(" ")),
        "invoice_number": F.col("invoice_number"),
        "invoice_date": F.col("invoice_date"),
        "due_date": F.col("due_date"),
        "total_amount": F.col("total_amount").cast("decimal(18,2)").cast("string"),
        "page_count": F.lit("1"),
    }
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(name).alias("type"), value.alias("value"))
            for i, (name, value) in enumerate(named.items())
        ]
    )
    first = invoices.select("invoice_id", F.inline(rows))
    again = F.struct(
        (F.col("ord") + 100).alias("ord"), F.col("type"), F.concat(F.lit("second "), F.col("value")).alias("value")
    )
    same = F.struct("ord", "type", "value")
    repeated = first.select(
        "invoice_id", F.inline(F.when((F.col("invoice_id") + F.col("ord")) % 8 == 0, F.array(same, again)).otherwise(F.array(same)))
    )
    tenths = ((F.col("invoice_id") + F.col("ord")) % 10).cast("double")
    return repeated.withColumn("confidence", tenths / 10.0)


def candidates(invoices: DataFrame) -> DataFrame:
    """one extraction attempt per method and invoice, some of them failed."""
    key = F.col("invoice_id")
    rows = F.array(
        *[
            F.struct(F.lit(method).alias("method"), ok.alias("ok"), amount.alias("total_amount"))
            for method, ok, amount in [
                ("google_document_ai", key % 3 != 0, F.col("total_amount")),
                ("gemini_extraction", key % 4 != 0, F.col("total_amount") + 1),
                ("pdf_extractor", F.lit(True), F.col("total_amount") + 2),
            ]
        ]
    )
    return invoices.select("invoice_id", F.inline(rows))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """F8: one uploaded file per order, with names and sizes around the limits."""
    key, limit = F.col("o_orderkey"), 35 * 1024 * 1024
    name = F.concat(F.lit("file-"), key.cast("string"))
    suffix = (
        F.when(key % 6 == 0, ".pdf")
        .when(key % 6 == 1, ".PDF")
        .when(key % 6 == 2, ".jpg")
        .when(key % 6 == 3, ".docx")
        .when(key % 6 == 4, ".txt")
    )
    return table(spark, folder, "orders").select(
        key.alias("file_id"),
        F.coalesce(F.concat(name, suffix), F.lit("")).alias("file_name"),
        F.when(_every(key, 50), F.lit(0))
        .when(_every(key, 49), F.lit(limit))
        .when(_every(key, 48), F.lit(limit + 1))
        .otherwise(key * 100 + 1)
        .cast("bigint")
        .alias("length"),
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """the files of F8 with the method asked for and the services that were there at the time."""
    key = F.col("file_id")
    asked = F.array(*[F.lit(m) for m in ("auto", "google_document_ai", "gemini_extraction", "pdf_extractor", "something")])
    return files(spark, folder).withColumns(
        {
            "requested": F.get(asked, (key % 5).cast("int")),
            "document_ready": F.floor(key / 12) % 2 == 0,
            "model_ready": F.floor(key / 6) % 3 != 1,
        }
    )


def document_answers(invoices: DataFrame) -> DataFrame:
    """what a document service says about each file: an invoice, or the text of its failure."""
    key = F.col("invoice_id")
    failed = key % 7 < 3
    fields = ["invoice_number", "vendor_name", "buyer_name", "invoice_date", "due_date", "currency"]
    return invoices.where(key % 11 != 0).select(
        key.alias("file_id"),
        F.when(failed, F.concat(F.lit("503 quota exceeded for file "), key.cast("string"))).alias("error"),
        *[F.when(~failed, F.col(f)).alias(f) for f in fields],
        *[F.when(~failed, F.col(f)).alias(f) for f in ("subtotal", "tax_amount", "total_amount")],
    )


def uploads_from_events(events: DataFrame) -> DataFrame:
    """F9 for the given events: uploads, with a repeat 500 ms later for every tenth event."""
    repeat = F.expr("ts + interval 500 milliseconds")
    moments = F.when(_every(F.col("event_id"), 10), F.array(F.col("ts"), repeat)).otherwise(F.array(F.col("ts")))
    return events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.explode(moments).alias("ts"),
    )


# What F12 writes: labels, and the kind of value behind each.
LABELS = {
    "number": [
        "Invoice", "INVOICE #", "Invoice Number", "inv-", "INV#", "# ", "Rechnung Nr", "Rechnung Nummer", "Rechnungsnummer",
        "Rechnungs-Nr", "rechnung ", "Ref #",
    ],
    "name": ["Bill To", "BILL  TO", "Buyer", "Customer", "Kunde", "Käufer", "KÄUFER", "Rechnungsempfänger", "An", "Ship To", "Sold To", "To", "ship to"],
    "date": [
        "Invoice Date", "Date", "Issued", "Datum", "Rechnungsdatum", "Ausstellungsdatum", "Due Date", "Payment Due",
        "Fälligkeitsdatum", "FÄLLIG AM", "Zahlungsziel",
    ],
    "amount": [
        "Total", "TOTAL AMOUNT", "Amount Due", "Grand Total", "Gesamtbetrag", "Gesamtsumme", "Endbetrag", "Summe", "Subtotal",
        "Sub Total", "Zwischensumme", "Tax", "VAT", "GST", "MwSt", "MwSt.", "Mehrwertsteuer", "Umsatzsteuer", "USt", "Steuer",
    ],
    "terms": ["Payment Terms", "Terms", "Net 45", "Due in", "due on", "Zahlungsbedingungen", "Zahlungsziel", "Zahlbar bis"],
}
LABEL_KINDS = [(label, kind) for kind, labels in LABELS.items() for label in labels]
SEPARATORS = [": ", "", " ", ":\n", " :\n\n  ", "\n"]
DATE_FORMS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy", "d.M.yyyy"]
CURRENCY_SIGNS = ["$", "€", "£", "₹", "USD ", ""]


def label_texts(spark: SparkSession, folder: str) -> DataFrame:
    """for every order a short text around one label, in turn of all labels, separators and forms of a value."""
    key = F.col("o_orderkey")
    n, m = len(LABEL_KINDS), len(SEPARATORS)

    def nth(values: list[str], at: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))

    turn, form = F.floor(key / n), F.floor(key / (n * m))
    label, kind = nth([label for label, _ in LABEL_KINDS], key), nth([kind for _, kind in LABEL_KINDS], key)
    day = F.lit(None)
    for i, pattern in enumerate(DATE_FORMS):
        day = F.when(F.pmod(form, F.lit(len(DATE_FORMS))) == i, F.date_format("o_orderdate", pattern)).otherwise(day)
    figure = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    value = (
        F.when(kind == "number", F.concat(key.cast("string"), F.lit("-A")))
        .when(kind == "name", F.concat(F.lit("Buyer Nr. "), key.cast("string"), F.lit("\n7 Lake Road\n12345 Town\n")))
        .when(kind == "date", day)
        .when(kind == "amount", F.concat(nth(CURRENCY_SIGNS, form), figure))
        .otherwise(F.concat(F.lit("30 days from "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    )
    name = F.concat(F.lit("Trader "), key.cast("string"))
    text = F.concat(name, F.lit("\n8 Hill Street\n"), label, nth(SEPARATORS, turn), value, F.lit("\nend\n"))
    return spread(table(spark, folder, "orders")).select(key.alias("invoice_id"), text.alias("text"))


def unusual_dates(spark: SparkSession, folder: str) -> DataFrame:
    """every order's date in forms that only the lenient reader knows, and some that are none."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    shape = key % 6
    text = (
        F.when(shape == 0, F.date_format(day, "d'th of 'MMMM yyyy"))
        .when(shape == 1, F.date_format(day, "MMMM"))
        .when(shape == 2, F.date_format(day, "EEE d MMM yyyy"))
        .when(shape == 3, F.date_format(day, "yyyy-MM-dd'T'13:45:00"))
        .when(shape == 4, F.date_format(day, "MMM. d, yyyy"))
        .otherwise(F.concat(F.lit("no day in "), F.date_format(day, "MMMM yyyy")))
    )
    return spread(table(spark, folder, "orders")).select(key.alias("invoice_id"), text.alias("text"))


def net_texts(spark: SparkSession, folder: str) -> DataFrame:
    """texts with a total and a tax, and no subtotal for most."""
    key = F.col("o_orderkey")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    tax = F.when(key % 5 == 0, money + 1).otherwise(F.round(money * F.lit(Decimal("0.1")), 2)).cast("decimal(18,2)")
    lines = [
        F.concat(F.lit("Total: $"), money.cast("string")),
        F.concat(F.when(key % 2 == 0, "VAT ").otherwise("Tax: €"), tax.cast("string")),
        F.when(key % 7 == 0, F.concat(F.lit("Zwischensumme "), (money - 3).cast("decimal(18,2)").cast("string"))).otherwise(""),
    ]
    return spread(table(spark, folder, "orders")).select(key.alias("invoice_id"), F.concat_ws("\n", *lines).alias("text"))


def item_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Short item tables as text, one per line item, for the item section reader."""
    name, qty = F.col("p_name"), F.col("l_quantity").cast("int").cast("string")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    total = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    german = F.col("l_linenumber") % 2 == 0
    joined = spread(table(spark, folder, "lineitem")).join(
        table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice"),
        F.col("p_partkey") == F.col("l_partkey"),
    )
    space = F.lit(" ")
    text = F.concat(
        F.lit("Delivery 10 20\n"),
        F.when(german, "Artikel Menge Preis Summe\n").otherwise("Description Qty Price Total\n"),
        F.concat(name, space, qty, space, price, space, total, F.lit("\n")),
        F.concat(F.initcap(name), F.lit(" (spare) "), qty, space, total, F.lit("\n")),
        F.concat(F.lit("note for "), name, space, qty, F.lit("\n")),
        F.concat(F.lit("7x "), name, space, qty, space, total, F.lit("\n")),
        F.when(german, "Zwischensumme ").otherwise("Subtotal "),
        total,
        F.concat(F.lit("\n"), name, F.lit(" 1 2 3\n")),
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text")
    )


def stored_invoices(invoices: DataFrame) -> DataFrame:
    """File references and creation moments, as the store would hold them."""
    key = F.col("invoice_id")
    return invoices.withColumns(
        {
            "file_id": F.when(_every(key, 10), _null("bigint")).when(_every(key, 14), key + 100_000_000_000).otherwise(key),
            "created_at": F.col("d").cast("timestamp_ntz"),
        }
    )
