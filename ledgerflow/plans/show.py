"""Print the physical plans of the registered queries.

    python -m ledgerflow.plans.show [--sf-dir DIR] [--large] [key ...]

``--large`` plans as for large tables: only tables measured under 4 KB may
be broadcast (the nation/region-sized dimensions), everything else is
planned as it would be at scale. Besides the registered queries it prints
the write sides of ``insert_if_absent`` and ``insert_keyed`` (the anti-joins
that are appended).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.operators.keyed_table import KeyedTable
from ledgerflow.operators.sync import absent_rows, batch_range, rows_between
from ledgerflow.plans.explain import plan_text
from ledgerflow.plans.standins import QUERIES, _events, _replica_events
from ledgerflow.schemas import TABLES
from ledgerflow.session import temporary_path

LARGE_TABLES = {
    "spark.sql.autoBroadcastJoinThreshold": "4096",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "4096",
}


def insert_write_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows ``insert_if_absent`` appends when the whole source meets the replica."""
    source = _events(spark, sf_dir)
    _, low, high = batch_range(source, "event_id")
    return absent_rows(source, rows_between(_replica_events(spark, sf_dir), "event_id", low, high), "event_id")


def keyed_write_side(spark: SparkSession, sf_dir: str, mode: str) -> str:
    """The plan of the same rows when the replica is bucketed by key."""
    table = KeyedTable.create(spark, temporary_path(spark, "keyed-events"), TABLES["events"], "event_id", 8)
    table.append(_replica_events(spark, sf_dir).repartition(8, "event_id"))
    source = _events(spark, sf_dir)
    _, low, high = batch_range(source, "event_id")
    with table.exchanges_as_bucketed():
        return plan_text(absent_rows(source, rows_between(table.rows(), "event_id", low, high), "event_id", join="merge"), mode)


def plans(spark: SparkSession, sf_dir: str, keys: list[str], mode: str = "simple") -> str:
    out = []
    for key in keys:
        if key == "insert_keyed:write":
            out.append(f"### {key}\n\n```\n{keyed_write_side(spark, sf_dir, mode).strip()}\n```\n")
            continue
        df = insert_write_side(spark, sf_dir) if key == "insert_if_absent:write" else QUERIES[key](spark, sf_dir)
        out.append(f"### {key}\n\n```\n{plan_text(df, mode).strip()}\n```\n")
    return "\n".join(out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m ledgerflow.plans.show")
    parser.add_argument("keys", nargs="*")
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    parser.add_argument("--large", action="store_true")
    parser.add_argument("--mode", default="simple")
    args = parser.parse_args(argv)

    from ledgerflow.session import build_session

    spark = build_session(app_name="ledgerflow-plans", conf=LARGE_TABLES if args.large else None)
    keys = args.keys or [*QUERIES, "insert_if_absent:write", "insert_keyed:write"]
    try:
        print(plans(spark, args.sf_dir, keys, args.mode))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
