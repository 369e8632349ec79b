"""Plan shapes that matter at scale, and a key holding a third of the rows."""

from __future__ import annotations

import contextlib
import datetime as dt
import glob
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF01
from ledgerflow.operators import first_per_key, insert_if_absent, top_customers, write_month_partitioned
from ledgerflow.plans import plan_text
from ledgerflow.plans.show import insert_write_side, plans
from ledgerflow.plans.standins import (
    q_monthly_revenue,
    q_overview_totals,
    q_top_customers,
    q_top_items,
)


@contextlib.contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def large_tables(spark):
    """Only tiny tables may broadcast, as when the fact tables are large."""
    return conf(
        spark,
        **{"spark.sql.autoBroadcastJoinThreshold": "4096", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4096"},
    )


def shuffles(df) -> int:
    return plan_text(df, "simple").count("Exchange hashpartitioning")


def test_top_items_four_shuffles_at_scale(spark):
    # lineitem by order key, orders by order key, per-item counts, customers by item key;
    # the regroup after the (broadcast) dimension lookups reuses the partitioning.
    with large_tables(spark):
        df = q_top_items(spark, SF01)
        text = plan_text(df, "simple")
        assert shuffles(df) == 4
        assert text.count("BroadcastHashJoin") == 2
        assert "partial_count(l_orderkey" in text


def test_top_customers_two_shuffles_at_scale(spark):
    with large_tables(spark):
        df = q_top_customers(spark, SF01)
        assert shuffles(df) == 2
        assert "partial_sum" in plan_text(df, "simple")


def test_scans_read_only_needed_columns(spark):
    text = plan_text(q_monthly_revenue(spark, SF01))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    totals = plan_text(q_overview_totals(spark, SF01))
    assert "Join" not in totals and "CartesianProduct" not in totals


def test_counts_read_no_columns(spark):
    # Four tables are only counted; the count of the fifth shares the scan of its money total.
    text = plan_text(q_overview_totals(spark, SF01))
    assert text.count("ReadSchema: struct<>") == 4 and "ReadSchema: struct<o_totalprice:double>" in text


def test_partition_pruning_through_a_join(spark, workdir):
    # A filter on a small joined table prunes the month folders of the fact at run time.
    base = dt.datetime(2022, 1, 1)
    rows = [(i, base + dt.timedelta(days=i)) for i in range(300)]
    path = f"{workdir}/pruned"
    write_month_partitioned(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), path, date_col="ts")
    spark.createDataFrame([("2022-02", 1), ("2022-03", 2)], "month string, q int").write.parquet(f"{workdir}/months")
    months = spark.read.parquet(f"{workdir}/months").where("q = 1")
    joined = spark.read.parquet(path).join(months, "month")
    assert "dynamicpruning" in plan_text(joined)
    assert joined.count() == 28


def test_insert_shuffles_the_batch_once(spark):
    with large_tables(spark):
        df = insert_write_side(spark, SF01)
        # the batch by key (also serving the anti-join), and the target's keys
        assert shuffles(df) == 2 and "partial_min_by" in plan_text(df)


SKEWED = T.StructType(
    [
        T.StructField("payment_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("amount", T.DecimalType(7, 2)),
    ]
)


def test_hot_customer_third_of_rows(spark):
    n = 3000
    rows = [(i, 0 if i % 3 == 0 else i, Decimal("1.00")) for i in range(n)]
    payment = spark.createDataFrame(rows, SKEWED).repartition(8)
    customer = spark.createDataFrame([(i, f"F{i}", "L", None) for i in range(n)],
                                     "customer_id long, first string, last string, email string")
    top = top_customers(customer, payment, customer_key="customer_id", first_name="first", last_name="last",
                        payment_customer_key="customer_id", amount="amount", payment_id="payment_id", k=2)
    got = [tuple(r) for r in top.collect()]
    assert got[0] == ("F0 L", Decimal("1000.00"), 1000)
    assert got[1] == ("F1 L", Decimal("1.00"), 1)


def test_hot_duplicate_key_deduplicated_map_side(spark, workdir):
    rows = [(5 if i % 3 == 0 else i, i, Decimal("2.00")) for i in range(3000)]
    batch = spark.createDataFrame(rows, SKEWED).repartition(8)
    firsts = first_per_key(batch, "payment_id", order_by=["customer_id"])
    assert firsts.where("payment_id = 5").collect()[0]["customer_id"] == 0
    # key 5 holds every third row plus its own; the other 1999 keys appear once
    assert firsts.count() == 2000
    assert "partial_min_by" in plan_text(firsts)
    target = f"{workdir}/skewed_target"
    assert insert_if_absent(spark, batch, target, "payment_id").inserted == firsts.count()


def test_hot_month_spread_over_files(spark, workdir):
    base = dt.datetime(2022, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), f"{'x' * 40}{i}") for i in range(6000)]
    rows += [(10_000 + i, dt.datetime(2022, 2, 1) + dt.timedelta(days=i % 20), "y") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, pad string").repartition(6)
    path = f"{workdir}/by_month"
    with conf(spark, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}):
        write_month_partitioned(df, path, date_col="ts", key_col="id")
    hot = glob.glob(f"{path}/month=2022-01/*.parquet")
    small = glob.glob(f"{path}/month=2022-02/*.parquet")
    assert len(hot) > 1, "the month with most rows is written by several tasks"
    assert len(small) >= 1
    back = spark.read.parquet(path)
    assert back.count() == 6060
    assert back.groupBy("month").count().orderBy("month").collect()[0]["count"] == 6000
    assert back.where(F.col("month") == "2022-02").count() == 60


def test_plan_printer(spark):
    text = plans(spark, SF01, ["top_customers", "insert_if_absent:write"])
    assert "### top_customers" in text and "TakeOrderedAndProject" in text
    assert "LeftAnti" in text
