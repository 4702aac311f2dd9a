"""The rule set on small fixtures: worked examples, boundaries, and properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybook.operators.validate import rule_hits, validate_invoices
from tallybook.sources import derived as D

GOOD = {
    "invoice_number": "INV-2024-001",
    "vendor_name": "Acme Corporation",
    "buyer_name": "Smith Enterprises",
    "invoice_date": "2024-01-15",
    "due_date": "2024-02-15",
    "currency": "USD",
    "subtotal": 1000.0,
    "tax_amount": 80.0,
    "total_amount": 1080.0,
}
AS_OF = "2024-12-31"


def validated(df, **options):
    return validate_invoices(df, AS_OF, **options).orderBy("invoice_id").collect()


def hits(df, **options):
    found = {}
    for row in rule_hits(df, AS_OF, **options).collect():
        found.setdefault(row.invoice_id, []).append(row.rule)
    return found


def test_worked_examples(invoices):
    rows = validated(
        invoices(
            GOOD,
            {**GOOD, "due_date": None},
            {**GOOD, "due_date": None, "subtotal": 2000.0, "tax_amount": 160.0, "total_amount": 2500.0},
            {"vendor_name": "Services Co", "total_amount": 1000.0},
        )
    )
    assert [(r.score, r.is_valid, len(r.errors), len(r.warnings)) for r in rows] == [
        (100, True, 0, 0),
        (95, True, 0, 1),
        (75, False, 1, 1),
        (55, False, 2, 3),
    ]
    assert rows[2].errors == [
        "Amount mismatch: Subtotal (2000.0) + Tax (160.0) does not equal Total (2500.0)"
    ]


@pytest.mark.parametrize(
    "change, rules",
    [
        ({"invoice_number": "  "}, ["V08"]),
        ({"invoice_number": ""}, ["V01"]),
        ({"total_amount": 0.0}, ["V03", "V12"]),
        ({"total_amount": -5.0, "subtotal": None}, ["V11"]),
        ({"total_amount": float("nan")}, []),
        ({"currency": "usd"}, ["V13"]),
        ({"due_date": "2024-01-14"}, ["V14"]),
        ({"due_date": "2025-01-14"}, []),
        ({"due_date": "2025-01-15"}, ["V15"]),
        ({"due_date": "2024-01-14T00:00:00Z"}, []),
        ({"invoice_date": "2024-02-20T00:00:00Z", "due_date": "2024-02-15T00:00:00Z"}, ["V14"]),
        ({"subtotal": 100.0, "tax_amount": 8.0, "total_amount": 108.01}, ["V16"]),
        ({"total_amount": 1080.01}, []),
        ({"tax_amount": 0.0, "total_amount": 5.0}, []),
        ({"vendor_name": "ACME", "buyer_name": "acme"}, ["V20"]),
        ({"invoice_date": "2025-01-30", "due_date": "2025-02-15"}, []),
        ({"invoice_date": "2025-01-31", "due_date": "2025-02-15"}, ["V21"]),
        ({"invoice_date": "2023-01-01", "due_date": "2023-02-15"}, []),
        ({"invoice_date": "2022-12-31", "due_date": "2023-02-15"}, ["V22"]),
        ({"invoice_date": "someday"}, ["V09"]),
        ({"due_date": "2024-02-30"}, ["V10"]),
        ({"invoice_date": "20th of January 2024"}, []),
        ({"subtotal": 1e7, "tax_amount": 1.0, "total_amount": 1e7 + 1}, ["V18"]),
        ({"line_items": [("a", 1.0, 1.0, 1000.02)]}, ["V17"]),
        ({"line_items": [("a", 1.0, 1.0, 999.0), ("b", None, None, None), ("c", 1.0, 1.0, 1.0)]}, []),
        ({"line_items": []}, []),
        ({"line_items": [("a", 1.0, 1.0, None)]}, []),
    ],
)
def test_single_rules(invoices, change, rules):
    assert hits(invoices({**GOOD, **change})).get(0, []) == rules


def test_documented_high_amount(invoices):
    big = {**GOOD, "subtotal": None, "total_amount": 2e7}
    assert hits(invoices(big)) == {0: ["V18"]}
    assert hits(invoices(big), documented_high_amount=True) == {0: ["V19"]}


def test_low_confidence_is_opt_in(invoices):
    df = invoices(GOOD).withColumn("confidence", F.lit(60.0))
    assert validated(df)[0].warnings == []
    row = validated(df, min_confidence=80)[0]
    assert len(row.warnings) == 1 and row.score == 100 and row.is_valid


def test_high_amount_text(invoices):
    row = validated(invoices({**GOOD, "subtotal": None, "total_amount": 12345678.9}))[0]
    assert row.warnings == ["Unusually high amount: 12345678.9"]


def test_score_properties(spark, data):
    df = D.invoices(spark, data)
    rows = validate_invoices(df, "2000-06-30")
    lost = rule_hits(df, "2000-06-30").groupBy("invoice_id").agg(F.sum("penalty").alias("lost"))
    joined = rows.join(lost, "invoice_id", "left")
    wrong = joined.filter(
        (F.col("score") != F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))))
        | (F.col("is_valid") != (F.size("errors") == 0))
        | ~F.col("score").between(0, 100)
    )
    assert wrong.count() == 0


def test_partitioning_does_not_matter(spark, data):
    df = D.invoices(spark, data)
    one = validate_invoices(df.coalesce(1), "2000-06-30").select("invoice_id", "score", "errors").collect()
    many = validate_invoices(df.repartition(7), "2000-06-30").select("invoice_id", "score", "errors").collect()
    assert sorted(one) == sorted(many)


def test_as_of_may_be_a_column(invoices):
    df = invoices(GOOD, GOOD).withColumn(
        "seen", F.when(F.col("invoice_id") == 0, F.lit(dt.date(2024, 2, 1))).otherwise(F.lit(dt.date(2030, 1, 1)))
    )
    rows = validate_invoices(df, F.col("seen")).orderBy("invoice_id").collect()
    assert [r.score for r in rows] == [100, 97]


def test_nested_items_match_preaggregated(spark, data):
    """A small nested table gives the same V17 as the pre-aggregated sums."""
    flat = D.invoices(spark, data)
    items = (
        spark.read.parquet(f"{data}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("invoice_id"))
        .agg(
            F.collect_list(
                F.struct(
                    F.lit("x").alias("description"),
                    F.col("l_quantity").alias("quantity"),
                    F.lit(None).cast("double").alias("price"),
                    F.col("l_extendedprice").alias("total"),
                )
            ).alias("line_items")
        )
    )
    nested = flat.drop("items_total").join(items, "invoice_id", "left")

    def v17(df):
        return {r.invoice_id for r in rule_hits(df, "2000-06-30").filter("rule = 'V17'").collect()}

    assert v17(nested) == v17(flat) != set()


def test_dashboard_loses_no_amount(spark):
    from tallybook.operators.stats import dashboard_stats

    amounts = [1e17, 5.0, None, float("nan"), 1e30] + [0.004] * 1000
    df = spark.createDataFrame([(a, True, 100) for a in amounts], "total_amount double, is_valid boolean, score int")
    row = dashboard_stats(df).first()
    assert row.total_amount == 1e17 + 9 and row.unsummed_amounts == 2
    small = dashboard_stats(df.where("total_amount < 1")).first()
    assert small.total_amount == 4.0 and dashboard_stats(df.limit(0)).first().total_amount == 0.0
