import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallybook.session import local_session  # noqa: E402

DATA = os.environ.get("TALLYBOOK_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def column(spark):
    """Evaluate a column expression over a list of texts, keeping their order."""
    from pyspark.sql import functions as F

    def run(values, build, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]

    return run


INVOICE_SCHEMA = (
    "invoice_id bigint, invoice_number string, vendor_name string, buyer_name string, vendor_address string, "
    "buyer_address string, invoice_date string, due_date string, currency string, subtotal double, "
    "tax_amount double, total_amount double, payment_terms string, "
    "line_items array<struct<description:string,quantity:double,price:double,total:double>>"
)


@pytest.fixture
def invoices(spark):
    """Invoice rows from dicts; fields that are not given are null."""
    names = [part.split(" ")[0] for part in INVOICE_SCHEMA.split(", ")]

    def make(*records):
        rows = [tuple({"invoice_id": i, **r}.get(n) for n in names) for i, r in enumerate(records)]
        return spark.createDataFrame(rows, INVOICE_SCHEMA)

    return make
