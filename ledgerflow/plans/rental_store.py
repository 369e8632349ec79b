"""The operators bound to the rental-store schema the library was written for.

Tables (Parquet folders ``<base>/<table>.parquet``, or any DataFrames with
these columns):

    customer(customer_id, first_name, last_name, email)
    payment(payment_id, customer_id, amount, payment_date)
    film(film_id, title, rental_rate)
    film_category(film_id, category_id)
    category(category_id, name)
    inventory(inventory_id, film_id)
    rental(rental_id, rental_date, inventory_id, customer_id, return_date, staff_id, last_update)
    actor(...)  counted only

Reports return DataFrames; ``document`` turns a bounded report into the
``{"data": [...], "data_source": ...}`` JSON document. Run as a module to
print a report:

    python -m ledgerflow.plans.rental_store overview --base /data/store [--fallback /data/copy]
    python -m ledgerflow.plans.rental_store replication --base /data/store --replica /data/copy
    python -m ledgerflow.plans.rental_store sync --base /data/store --replica /data/copy [--cap N]
    python -m ledgerflow.plans.rental_store query --base /data/store \\
        --sql "SELECT * FROM rental WHERE rental_id > :since" --arg since=100
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.operators.rankings import top_customers, top_items
from ledgerflow.operators.revenue import monthly_revenue
from ledgerflow.operators.statements import statement
from ledgerflow.operators.status import ha_status, nest_status, sync_status
from ledgerflow.operators.sync import run_sync
from ledgerflow.operators.totals import overview_totals
from ledgerflow.sources.fallback import FALLBACK, PRIMARY, NoReadableSource, Side, open_side
from ledgerflow.sources.sinks import json_document, json_rows
from ledgerflow.sources.tables import read_table

# Table names of the rental-store schema.
TABLE_NAMES = ("customer", "payment", "film", "film_category", "category", "inventory", "rental", "actor")
# Tables compared between source and replica, by report field.
COMPARED = {"customers": "customer", "rentals": "rental", "payments": "payment", "films": "film"}
# The synced table and its key.
SYNCED_TABLE, SYNCED_KEY = "rental", "rental_id"
TOP_K = 10


def overview(spark: SparkSession, t: Mapping[str, DataFrame], data_source: str | None = None) -> DataFrame:
    return overview_totals(
        spark,
        counted={
            "total_customers": t["customer"],
            "total_films": t["film"],
            "total_rentals": t["rental"],
            "total_actors": t["actor"],
            "total_inventory": t["inventory"],
        },
        revenue=("total_revenue", t["payment"], "amount"),
        order=["total_customers", "total_films", "total_rentals", "total_revenue", "total_actors", "total_inventory"],
        data_source=data_source,
    )


def films(t: Mapping[str, DataFrame], k: int = TOP_K) -> DataFrame:
    return top_items(
        t["film"], t["film_category"], t["category"], t["inventory"], t["rental"],
        item_key="film_id", item_title="title", item_rate="rental_rate",
        bridge_item_key="film_id", bridge_category_key="category_id",
        category_key="category_id", category_name="name",
        unit_key="inventory_id", unit_item_key="film_id",
        activity_unit_key="inventory_id", activity_id="rental_id",
        k=k,
    )


def customers(t: Mapping[str, DataFrame], k: int = TOP_K) -> DataFrame:
    return top_customers(
        t["customer"], t["payment"],
        customer_key="customer_id", first_name="first_name", last_name="last_name", email="email",
        payment_customer_key="customer_id", amount="amount", payment_id="payment_id",
        k=k,
    )


def revenue(t: Mapping[str, DataFrame]) -> DataFrame:
    return monthly_revenue(t["payment"], date_col="payment_date", amount="amount", payment_id="payment_id")


def replication(spark: SparkSession, source: Side, replica: Side) -> DataFrame:
    return nest_status(sync_status(spark, source, replica, list(COMPARED)), list(COMPARED))


def failover(spark: SparkSession, source: Side, replica: Side) -> DataFrame:
    return ha_status(spark, source, replica, list(COMPARED))


# Reports that are lists, in the order of their ranking.
LIST_REPORTS = ("films", "customers", "revenue")


def document(report: DataFrame, name: str, data_source: str | None) -> DataFrame:
    """The report as one JSON document (list reports) or one JSON object (one-row reports)."""
    return json_document(report, data_source) if name in LIST_REPORTS else json_rows(report)


def open_store(spark: SparkSession, candidates: list[tuple[str, str]]) -> tuple[dict[str, DataFrame], str]:
    """All tables from the first copy where every table is readable, and that copy's name."""
    errors = []
    for name, base in candidates:
        side = open_side(spark, name, base, {t: t for t in TABLE_NAMES}, probe=True)
        if side.online:
            return side.tables, name
        errors.append(f"{name}: {side.error}")
    raise NoReadableSource("no readable copy of the store | " + " | ".join(errors))


def register_views(spark: SparkSession, candidates: list[tuple[str, str]]) -> str:
    """Register the store's tables as temporary views for ``spark.sql``; returns the copy used.

    The copy is chosen as for the reports (first one whose tables are all
    readable), so SQL written against the store runs on Spark unchanged
    apart from dialect (e.g. ``CAST(x AS DECIMAL(38,2))``, ``date_format``).
    """
    tables, used = open_store(spark, candidates)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return used


def sync_rentals(
    spark: SparkSession,
    base: str,
    replica: str,
    cap: int | None = None,
    log_path: str | None = None,
) -> list[str]:
    """Copy new ``rental`` rows from the source copy into the replica copy.

    Runs cycles (of ``cap`` rows each, if given) until one finds nothing;
    returns one JSON object per cycle (found, first/last key, inserted,
    watermark, counts, remaining lag).
    """
    read_table(spark, base, SYNCED_TABLE)  # fail fast when the source copy is missing
    target = f"{replica.rstrip('/')}/{SYNCED_TABLE}.parquet"
    results = run_sync(spark, lambda: read_table(spark, base, SYNCED_TABLE), target, SYNCED_KEY,
                       cap=cap, log_path=log_path)
    shown = [{k: v for k, v in asdict(r).items() if k not in ("stage", "range_before", "error")} for r in results]
    return [json.dumps(r, default=str) for r in shown]


def query(spark: SparkSession, base: str, fallback: str | None, text: str, given: list[str]) -> list[str]:
    """Run a statement over the store's views; ``name=value`` bind its markers. One JSON object per row.

    A value that reads as a JSON number, ``true`` or ``false`` is one; everything else is text.
    """
    register_views(spark, [(PRIMARY, base)] + ([(FALLBACK, fallback)] if fallback else []))
    return [row[0] for row in json_rows(statement(spark, text, dict(map(parameter, given)))).toLocalIterator()]


def parameter(given: str) -> tuple[str, object]:
    """(name, typed value) of ``name=value``."""
    name, _, value = given.partition("=")
    try:
        typed = json.loads(value)
    except ValueError:
        typed = value
    return name, typed if isinstance(typed, (bool, int, float)) else value


def run_report(
    spark: SparkSession,
    report: str,
    base: str,
    fallback: str | None = None,
    replica: str | None = None,
) -> list[str]:
    """The report's JSON text: one document, or one object for one-row reports."""
    if report in ("replication", "failover"):
        source = open_side(spark, "source", base, COMPARED)
        other = open_side(spark, "replica", replica, COMPARED)
        out = json_rows((replication if report == "replication" else failover)(spark, source, other))
    else:
        candidates = [(PRIMARY, base)] + ([(FALLBACK, fallback)] if fallback else [])
        tables, used = open_store(spark, candidates)
        if report == "overview":
            out = json_rows(overview(spark, tables, used))
        else:
            out = document({"films": films, "customers": customers, "revenue": revenue}[report](tables),
                           report, used)
    return [row[0] for row in out.collect()]  # one document or one object: bounded


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m ledgerflow.plans.rental_store")
    parser.add_argument(
        "report", choices=["overview", "films", "customers", "revenue", "replication", "failover", "sync", "query"]
    )
    parser.add_argument("--base", required=True, help="folder holding <table>.parquet (the source)")
    parser.add_argument("--fallback", help="second copy read when the base copy is unreadable")
    parser.add_argument("--replica", help="replica copy for replication / failover")
    parser.add_argument("--sql", help="statement for query, over the store's tables, with markers such as :since")
    parser.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE", help="value of a marker")
    parser.add_argument("--cap", type=int, help="rows per sync cycle (default: all that is new)")
    parser.add_argument("--log", help="Parquet table receiving one row per sync cycle")
    args = parser.parse_args(argv)

    from ledgerflow.session import build_session

    spark = build_session(app_name=f"rental-store-{args.report}")
    try:
        if args.report == "sync":
            if not args.replica:
                parser.error("sync needs --replica")
            for line in sync_rentals(spark, args.base, args.replica, args.cap, args.log):
                print(line)
            return
        if args.report == "query":
            if not args.sql:
                parser.error("query needs --sql")
            for line in query(spark, args.base, args.fallback, args.sql, args.arg):
                print(line)
            return
        for text in run_report(spark, args.report, args.base, args.fallback, args.replica):
            print(json.dumps(json.loads(text), indent=2))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
