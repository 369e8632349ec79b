"""Replica copies of the test tables, written under the shared folder at every call.

The replica of a table set lags its source: tables without a sync feed are
full copies, synced tables hold only the rows with a key up to the middle
of the source's key range (``(min + max) div 2``). The cut is computed from
the data, so the replica and the backlog both grow with the tables. The
events a replica holds have values of their own, so a sync that overwrote
them would show.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.schemas import KEYS, TABLES
from ledgerflow.session import temporary_path
from ledgerflow.sources.tables import read_table, table_path

# Tables the replica holds only partly (the synced ones).
LAGGING = ("events", "orders")


def lagging_copy(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is at most the middle of the key range."""
    middle = df.where(F.col(key).isNotNull()).select(F.expr(f"(min({key}) + max({key})) div 2")).scalar()
    return df.where(F.col(key) <= middle)


def replica_rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = read_table(spark, sf_dir, table, TABLES[table])
    if table in LAGGING:
        df = lagging_copy(df, KEYS[table])
    if table == "events":
        df = df.withColumn("value", F.col("value") + 1000).withColumn("event_type", F.lit("replica"))
    return df


def write_replica(spark: SparkSession, sf_dir: str, tables: Iterable[str]) -> str:
    """A new replica of ``tables``; returns its base folder."""
    base = temporary_path(spark, "replica")
    for table in tables:
        replica_rows(spark, sf_dir, table).write.parquet(table_path(base, table))
    return base


def fresh_target(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A new, writable replica of one table; returns its path."""
    return table_path(write_replica(spark, sf_dir, [table]), table)
