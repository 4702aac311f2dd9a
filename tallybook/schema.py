"""Column names and types of the tables this library reads and writes.

Dates stay strings: a badly formatted date is data that the validation rules report on.
Amounts stay doubles because the rule tolerances compare binary floats.
"""

from __future__ import annotations

from pyspark.sql import types as T

ITEM_TYPE = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("total", T.DoubleType()),
    ]
)

TEXT_FIELDS = [
    "invoice_number",
    "vendor_name",
    "buyer_name",
    "vendor_address",
    "buyer_address",
    "invoice_date",
    "due_date",
    "currency",
    "payment_terms",
]

AMOUNT_FIELDS = ["subtotal", "tax_amount", "total_amount"]

INVOICE_FIELDS = [
    "invoice_number",
    "vendor_name",
    "buyer_name",
    "vendor_address",
    "buyer_address",
    "invoice_date",
    "due_date",
    "currency",
    "subtotal",
    "tax_amount",
    "total_amount",
    "payment_terms",
]

INVOICE_TYPE = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name in AMOUNT_FIELDS else T.StringType())
        for name in INVOICE_FIELDS
    ]
    + [T.StructField("line_items", T.ArrayType(ITEM_TYPE))]
)

# GST-flavoured shape: every value, amounts included, is a string.
GST_FIELDS = [
    "supplier_name",
    "supplier_address",
    "supplier_gst",
    "customer_name",
    "customer_address",
    "customer_gst",
    "invoice_number",
    "invoice_date",
    "due_date",
    "subtotal",
    "tax_amount",
    "total_amount",
]

GST_ITEM_FIELDS = ["description", "quantity", "unit_price", "tax_percent", "amount"]

GST_ITEM_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in GST_ITEM_FIELDS])
