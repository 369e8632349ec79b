"""The operators bound to the test tables (roles: see the README).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables in ``sf_dir``. ``QUERIES`` maps the registered names to them;
``ledgerflow.plans.oracle.ORACLE_SQL`` holds the equivalent SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators.rankings import top_customers, top_items
from ledgerflow.operators.revenue import (
    monthly_revenue,
    monthly_revenue_partitioned,
    read_month_partitioned,
    refresh_month_partitioned,
    write_month_partitioned,
)
from ledgerflow.operators.statements import batch_statement
from ledgerflow.operators.status import ha_status, nest_status, sync_status
from ledgerflow.operators.keyed_table import KeyedTable, buckets_for
from ledgerflow.operators.sync import (
    batch_edges,
    high_watermark,
    high_watermark_value,
    incremental_batch,
    insert_if_absent,
    run_sync,
)
from ledgerflow.operators.sync_log import log_schema, read_failures, read_log
from ledgerflow.operators.totals import overview_totals
from ledgerflow.plans.replicas import fresh_target, write_replica
from ledgerflow.schemas import STATUS_TABLES, TABLES
from ledgerflow.session import temporary_path
from ledgerflow.sources.fallback import FALLBACK, PRIMARY, open_side, read_with_fallback, with_source
from ledgerflow.sources.sinks import json_document, json_rows
from ledgerflow.sources.tables import load_test_tables, read_table, table_path
from ledgerflow.streaming.supervisor import StopGate, run_supervised
from ledgerflow.streaming.sync_stream import start_sync, sync_until_caught_up

# Watermark default used when the target is empty (below every event id).
EMPTY_TARGET_WATERMARK = -1
# Rows per incremental batch.
BATCH_CAP = 100
# Parts in which the streamed events land, a micro-batch each.
LANDINGS = 3


def q_overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_test_tables(spark, sf_dir, ["customer", "part", "lineitem", "supplier", "orders"])
    return overview_totals(
        spark,
        counted={
            "total_customers": t["customer"],
            "total_films": t["part"],
            "total_rentals": t["lineitem"],
            "total_actors": t["supplier"],
            "total_inventory": t["orders"],
        },
        revenue=("total_revenue", t["orders"], "o_totalprice"),
        order=["total_customers", "total_films", "total_rentals", "total_revenue", "total_actors", "total_inventory"],
        data_source=PRIMARY,
    )


def q_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_test_tables(spark, sf_dir, ["customer", "nation", "region", "orders", "lineitem"])
    return top_items(
        t["customer"], t["nation"], t["region"], t["orders"], t["lineitem"],
        item_key="c_custkey", item_title="c_name", item_rate="c_acctbal", item_link="c_nationkey",
        bridge_item_key="n_nationkey", bridge_category_key="n_regionkey",
        category_key="r_regionkey", category_name="r_name",
        unit_key="o_orderkey", unit_item_key="o_custkey",
        activity_unit_key="l_orderkey", activity_id="l_orderkey",
        k=10,
    )


def q_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_test_tables(spark, sf_dir, ["customer", "orders"])
    return top_customers(
        t["customer"], t["orders"],
        customer_key="c_custkey", first_name="c_name", last_name="c_mktsegment", email="c_name",
        payment_customer_key="o_custkey", amount="o_totalprice", payment_id="o_orderkey",
        k=10,
    )


def q_monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", TABLES["orders"])
    return monthly_revenue(orders, date_col="o_orderdate", amount="o_totalprice", payment_id="o_orderkey")


def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table in its month-partitioned layout, written anew."""
    path = temporary_path(spark, "orders-by-month")
    orders = read_table(spark, sf_dir, "orders", TABLES["orders"])
    write_month_partitioned(orders, path, date_col="o_orderdate", key_col="o_orderkey")
    return read_month_partitioned(spark, path, TABLES["orders"])


def q_monthly_revenue_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_revenue_partitioned(orders_by_month(spark, sf_dir), amount="o_totalprice", payment_id="o_orderkey")


def q_monthly_revenue_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue over a layout that held other prices in the first month and lacked the last one, brought up to date."""
    path = temporary_path(spark, "orders-refreshed")
    orders = read_table(spark, sf_dir, "orders", TABLES["orders"])
    span = orders.agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high")).first()
    month = F.trunc(F.col("o_orderdate"), "month")
    first, last = (F.trunc(F.lit(span[c]), "month") for c in ("low", "high"))
    earlier = orders.where((month < last) | F.col("o_orderdate").isNull()).withColumn(
        "o_totalprice", F.when(month == first, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    for state in (earlier, orders):
        refresh_month_partitioned(state, path, date_col="o_orderdate", key_col="o_orderkey")
    layout = read_month_partitioned(spark, path, TABLES["orders"])
    return monthly_revenue_partitioned(layout, amount="o_totalprice", payment_id="o_orderkey")


def _events(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "events", TABLES["events"])


def _replica_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, write_replica(spark, sf_dir, ["events"]))


# Log columns compared by the registered queries (time and run id vary per run).
_NOT_COMPARED = ("logged_at", "run", "stage", "range_before", "error")
LOG_COLUMNS = [f.name for f in log_schema(T.LongType()).fields if f.name not in _NOT_COMPARED]


def q_high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_watermark(_replica_events(spark, sf_dir), "event_id", init=EMPTY_TARGET_WATERMARK)


def q_incremental_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = high_watermark_value(_replica_events(spark, sf_dir), "event_id", init=EMPTY_TARGET_WATERMARK)
    return incremental_batch(_events(spark, sf_dir), "event_id", since, BATCH_CAP)


def q_parameterised_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental batch as a statement whose names and values are bound, not written into it."""
    since = high_watermark_value(_replica_events(spark, sf_dir), "event_id", init=EMPTY_TARGET_WATERMARK)
    events = _events(spark, sf_dir)
    events.createOrReplaceTempView("ledgerflow_events")
    return batch_statement(spark, "ledgerflow_events", events.columns, "event_id", since, BATCH_CAP)


def _with_repeats(events: DataFrame) -> DataFrame:
    """The events, and for two keys of three another row whose value is lower or higher by 1."""
    turn = F.pmod(F.col("event_id"), F.lit(3))
    again = events.where(turn < 2).withColumn("value", F.col("value") + F.when(turn == 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    return events.unionByName(again)


def q_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert the whole source, keys repeated, into a lagging replica; the target afterwards.

    The replica's rows stay as they are; of the rows of a new key the one with the lowest value is inserted.
    """
    target = fresh_target(spark, sf_dir, "events")
    insert_if_absent(spark, _with_repeats(_events(spark, sf_dir)), target, "event_id", order_by=["value"])
    return spark.read.schema(TABLES["events"]).parquet(target)


def q_insert_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same insert into a replica that is bucketed and sorted by the key."""
    replica = _replica_events(spark, sf_dir)
    target = KeyedTable.create(
        spark, temporary_path(spark, "keyed-events"), TABLES["events"], "event_id", buckets_for(replica.count())
    )
    target.append(replica.repartition(target.buckets, "event_id"))
    insert_if_absent(spark, _with_repeats(_events(spark, sf_dir)), target.path, "event_id", order_by=["value"])
    return target.rows()


def q_batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches of the backlog of the lagging replica, keys repeated, planned in one pass."""
    since = high_watermark_value(_replica_events(spark, sf_dir), "event_id", init=EMPTY_TARGET_WATERMARK)
    return batch_edges(_with_repeats(_events(spark, sf_dir)), "event_id", BATCH_CAP, since)


def q_sync_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the whole events table into a lagging replica until caught up; the target afterwards."""
    target = fresh_target(spark, sf_dir, "events")
    sync_until_caught_up(
        spark, table_path(sf_dir, "events"), TABLES["events"], target, "event_id",
        checkpoint=temporary_path(spark, "sync-checkpoint"),
    )
    return spark.read.schema(TABLES["events"]).parquet(target)


def q_sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events land in parts of their key range, each streamed as a micro-batch before the next lands; the log."""
    events = _events(spark, sf_dir)
    span = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    edges = [low + (high + 1 - low) * i // LANDINGS for i in range(LANDINGS + 1)]
    landing, checkpoint = temporary_path(spark, "landing"), temporary_path(spark, "sync-checkpoint")
    target, log = fresh_target(spark, sf_dir, "events"), temporary_path(spark, "sync-log")
    for first, after in zip(edges, edges[1:]):
        part = events.where((F.col("event_id") >= first) & (F.col("event_id") < after))
        part.write.mode("append").parquet(landing)
        sync_until_caught_up(
            spark, landing, TABLES["events"], target, "event_id", log_path=log, with_counts=True, checkpoint=checkpoint
        )
    return read_log(spark, log).select(*LOG_COLUMNS)


class _Outage(StopGate):
    """Lets the first batch pass and turns the next two attempts away, as a source that is away for a while would."""

    def __init__(self) -> None:
        super().__init__()
        self.away = 2

    def enter(self, batch_id: int) -> None:
        super().enter(batch_id)
        if batch_id and self.away:
            self.away -= 1
            raise ConnectionError("source is away")


def q_sync_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events land in parts, each brought by a keyed-state stream; the second one fails twice and is started again. Its log by batch."""
    events = _events(spark, sf_dir)
    landing, target = temporary_path(spark, "landing"), fresh_target(spark, sf_dir, "events")
    checkpoint, log = temporary_path(spark, "sync-checkpoint"), temporary_path(spark, "sync-log")

    def start(gate: StopGate):
        return start_sync(
            spark, landing, TABLES["events"], target, "event_id", checkpoint, log,
            available_now=True, keyed_state=True, gate=gate,
        )

    outage = _Outage()
    for part in range(LANDINGS):
        events.where(F.pmod(F.col("event_id"), F.lit(LANDINGS)) == part).write.mode("append").parquet(landing)
        run_supervised(spark, start, outage, (log, checkpoint, T.LongType()), first_delay=0.1)
    failed = read_failures(spark, log).groupBy("cycle").agg(F.count(F.lit(1)).alias("failures"), F.max("error").alias("error"))
    left = spark.read.schema(TABLES["events"]).parquet(target).agg(F.count(F.lit(1)).alias("target_rows"))
    results = read_log(spark, log).select("cycle", "last_key")
    return results.join(failed, "cycle", "left").select(
        "cycle", "last_key", F.coalesce("failures", F.lit(0).cast("long")).alias("failures"), "error", left.scalar().alias("target_rows")
    )


def q_sync_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle loop over the whole table: its per-cycle log."""
    target, log = fresh_target(spark, sf_dir, "events"), temporary_path(spark, "sync-cycles-log")
    run_sync(spark, _events(spark, sf_dir), target, "event_id", log_path=log)
    return read_log(spark, log).select(*LOG_COLUMNS)


def _absent(sf_dir: str) -> str:
    """A copy location that does not exist (the test folder is read-only)."""
    return f"{sf_dir.rstrip('/')}/absent-copy"


def _sides(spark: SparkSession, sf_dir: str):
    replica_base = write_replica(spark, sf_dir, STATUS_TABLES.values())
    source = open_side(spark, "source", sf_dir, STATUS_TABLES, schemas=TABLES)
    return source, open_side(spark, "replica", replica_base, STATUS_TABLES, schemas=TABLES)


def q_sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_status(spark, *_sides(spark, sf_dir), list(STATUS_TABLES), with_checked_at=False)


def q_status_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status row as one JSON object of ``source``, ``replica`` and ``sync_lag``."""
    return json_rows(nest_status(q_sync_status(spark, sf_dir), list(STATUS_TABLES)))


def q_ha_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability from the counts of all compared tables on both sides."""
    status = ha_status(spark, *_sides(spark, sf_dir), list(STATUS_TABLES), with_checked_at=False)
    return status.drop("source_location", "replica_location")


def q_fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = [(PRIMARY, _absent(sf_dir)), (FALLBACK, sf_dir)]
    orders, used = read_with_fallback(spark, candidates, "orders", schema=TABLES["orders"])
    revenue = monthly_revenue(orders, date_col="o_orderdate", amount="o_totalprice", payment_id="o_orderkey")
    return with_source(revenue, used)


def q_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(q_monthly_revenue(spark, sf_dir))


def q_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top customers as one ``{"data": [...], "data_source": ...}`` document, in ranking order."""
    return json_document(q_top_customers(spark, sf_dir), data_source=PRIMARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "overview_totals": q_overview_totals,
    "top_items": q_top_items,
    "top_customers": q_top_customers,
    "monthly_revenue": q_monthly_revenue,
    "monthly_revenue_partitioned": q_monthly_revenue_partitioned,
    "monthly_revenue_refreshed": q_monthly_revenue_refreshed,
    "high_watermark": q_high_watermark,
    "incremental_batch": q_incremental_batch,
    "parameterised_batch": q_parameterised_batch,
    "insert_if_absent": q_insert_if_absent,
    "insert_keyed": q_insert_keyed,
    "batch_edges": q_batch_edges,
    "sync_converged": q_sync_converged,
    "sync_log": q_sync_log,
    "sync_retried": q_sync_retried,
    "sync_cycles": q_sync_cycles,
    "sync_status": q_sync_status,
    "status_document": q_status_document,
    "ha_status": q_ha_status,
    "fallback_source": q_fallback_source,
    "json_rows": q_json_rows,
    "json_document": q_json_document,
}
