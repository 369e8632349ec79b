"""Monthly revenue (plain and month-partitioned) and overview totals (F8, F9)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from ledgerflow.operators import (
    monthly_revenue,
    monthly_revenue_partitioned,
    overview_totals,
    read_month_partitioned,
    write_month_partitioned,
)
from ledgerflow.plans import plan_text

PAYMENT = T.StructType(
    [
        T.StructField("payment_id", T.LongType(), True),
        T.StructField("customer_id", T.LongType(), True),
        T.StructField("amount", T.DecimalType(5, 2), True),
        T.StructField("payment_date", T.TimestampNTZType(), True),
    ]
)


def _payments(spark):
    rows = [
        (1, 1, Decimal("1.10"), dt.datetime(2022, 1, 3, 10)),
        (2, 1, Decimal("2.20"), dt.datetime(2022, 1, 31, 23, 59, 59)),
        (3, 2, Decimal("3.30"), dt.datetime(2022, 3, 1, 0, 0)),
        (4, 2, Decimal("4.40"), None),
        (None, 3, Decimal("5.50"), dt.datetime(2022, 3, 9)),
    ]
    return spark.createDataFrame(rows, PAYMENT)


def _revenue(df):
    return monthly_revenue(df, date_col="payment_date", amount="amount", payment_id="payment_id")


def test_months_in_order_null_last_no_gap_fill(spark):
    # F8: 2022-01, 2022-03, then the NULL month; no 2022-02 row.
    rows = [tuple(r) for r in _revenue(_payments(spark)).collect()]
    assert rows == [
        ("2022-01", Decimal("3.30"), 2),
        ("2022-03", Decimal("8.80"), 1),   # NULL payment id not counted, amount summed
        (None, Decimal("4.40"), 1),
    ]


def test_empty_fact(spark):
    # no months; totals NULL and counts 0.
    empty = spark.createDataFrame([], PAYMENT)
    assert _revenue(empty).collect() == []
    row = overview_totals(
        spark, {"total_rentals": empty}, ("total_revenue", empty, "amount"), data_source="primary"
    ).collect()[0]
    assert row.asDict() == {"total_rentals": 0, "total_revenue": None, "data_source": "primary"}


def test_overview_one_row_without_joins(spark):
    pay = _payments(spark)
    df = overview_totals(
        spark,
        {"total_payments": pay, "total_customers": pay.select("customer_id").distinct()},
        ("total_revenue", pay, "amount"),
        order=["total_customers", "total_payments", "total_revenue"],
    )
    assert [tuple(r) for r in df.collect()] == [(3, 5, Decimal("16.50"))]
    text = plan_text(df)
    assert "Join" not in text and "CartesianProduct" not in text


def test_partitioned_layout_same_answer_and_pruned(spark, workdir):
    pay = _payments(spark)
    path = f"{workdir}/payment_by_month"
    write_month_partitioned(pay, path, date_col="payment_date", key_col="payment_id")
    stored = read_month_partitioned(spark, path, PAYMENT)
    flat = [tuple(r) for r in _revenue(pay).collect()]
    parted = monthly_revenue_partitioned(stored, amount="amount", payment_id="payment_id")
    assert [tuple(r) for r in parted.collect()] == flat
    one = monthly_revenue_partitioned(stored, amount="amount", payment_id="payment_id", months=("2022-03", "2022-03"))
    assert [tuple(r) for r in one.collect()] == [("2022-03", Decimal("8.80"), 1)]
    text = plan_text(one)
    assert "PartitionFilters: [isnotnull(month" in text and "2022-03" in text


def test_reload_one_month_keeps_the_others(spark, workdir):
    pay = _payments(spark)
    path = f"{workdir}/reload"
    write_month_partitioned(pay, path, date_col="payment_date", key_col="payment_id")
    march = spark.createDataFrame([(9, 4, Decimal("10.00"), dt.datetime(2022, 3, 20))], PAYMENT)
    write_month_partitioned(march, path, date_col="payment_date", replace_months_only=True)
    stored = read_month_partitioned(spark, path, PAYMENT)
    rows = [tuple(r) for r in monthly_revenue_partitioned(stored, amount="amount", payment_id="payment_id").collect()]
    assert rows == [("2022-01", Decimal("3.30"), 2), ("2022-03", Decimal("10.00"), 1), (None, Decimal("4.40"), 1)]


def test_doubles_are_rounded_once_after_the_sum(spark):
    rows = [(i, x, dt.datetime(2022, 1, 1)) for i, x in enumerate([0.005, 0.005, 0.005])]
    doubles = spark.createDataFrame(rows, "payment_id long, amount double, payment_date timestamp_ntz")
    assert [tuple(r) for r in _revenue(doubles).collect()] == [("2022-01", Decimal("0.02"), 3)]
    large = spark.createDataFrame([(1, 1e17, dt.datetime(2022, 1, 1))], doubles.schema)
    assert _revenue(large).collect()[0]["revenue"] == Decimal("100000000000000000.00")
    total = overview_totals(spark, {"n": doubles}, ("total", doubles, "amount")).collect()[0]["total"]
    assert total == Decimal("0.02")
