"""Source-versus-replica status and availability.

``sync_status`` compares row counts of the same tables in two copies and
labels the result; ``ha_status`` is the same row with the availability
label. Each side is counted once (``count_side``), by one query whose
figures are scalar subqueries (one partial count per task, no columns read).

A side that cannot be opened (``ledgerflow.sources.open_side``) or counted
is offline: its counts are NULL and it carries its error text; differences
are only filled when both sides are online. Nothing raises.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.functions.labels import OFFLINE, ONLINE, availability_label, overall_label
from ledgerflow.functions.money import utc_stamp
from ledgerflow.operators.totals import count_of, one_row
from ledgerflow.sources.fallback import Side, first_line


def count_side(spark: SparkSession, side: Side) -> Side:
    """``side`` with the row count of each of its tables; offline if any cannot be counted.

    Every file of every table is opened, so a damaged one shows wherever it
    stands.
    """
    if not side.online or side.counts is not None:
        return side
    try:
        counts = one_row(spark, {name: count_of(df) for name, df in side.tables.items()}).first().asDict()
    except Exception as exc:  # noqa: BLE001 - a copy that cannot be counted is reported, not raised
        return replace(side, tables={}, error=first_line(exc))
    return replace(side, counts=counts)


def _state(side: Side) -> Column:
    return F.lit(ONLINE if side.online else OFFLINE)


def _text(value: str | None) -> Column:
    return F.lit(value).cast(T.StringType())


def _count(side: Side, name: str) -> Column:
    return F.lit((side.counts or {}).get(name)).cast(T.LongType())


def sync_status(
    spark: SparkSession,
    source: Side,
    replica: Side,
    names: Sequence[str],
    checked_at: str | Column | None = None,
    with_checked_at: bool = True,
) -> DataFrame:
    """One row: both sides' states and counts, per-table differences, overall label.

    Columns: ``source_status``, ``source_<name>``..., ``replica_status``,
    ``replica_<name>``..., ``lag_<name>``... (source minus replica, NULL
    unless both online), ``overall_status``, ``source_error``,
    ``replica_error`` and ``checked_at`` (the current UTC time unless given).
    """
    source, replica = count_side(spark, source), count_side(spark, replica)
    row = spark.range(1).select(
        _state(source).alias("source_status"),
        *[_count(source, n).alias(f"source_{n}") for n in names],
        _state(replica).alias("replica_status"),
        *[_count(replica, n).alias(f"replica_{n}") for n in names],
        _text(source.error).alias("source_error"),
        _text(replica.error).alias("replica_error"),
    )
    # A NULL count on either side leaves the difference NULL.
    out = row.select("*", *[(F.col(f"source_{n}") - F.col(f"replica_{n}")).alias(f"lag_{n}") for n in names])
    out = out.withColumn(
        "overall_status",
        overall_label(F.col("source_status"), F.col("replica_status"), [F.col(f"lag_{n}") for n in names]),
    )
    if with_checked_at:
        out = out.withColumn("checked_at", utc_stamp(checked_at))
    return out


def nest_status(status: DataFrame, names: Sequence[str]) -> DataFrame:
    """Regroup a ``sync_status`` row into ``source`` / ``replica`` / ``sync_lag`` structs."""
    def side(prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}_status").alias("status"),
            *[F.col(f"{prefix}_{n}").alias(n) for n in names],
            F.col(f"{prefix}_error").alias("error"),
        )

    rest = [c for c in ("overall_status", "checked_at") if c in status.columns]
    return status.select(
        side("source").alias("source"),
        side("replica").alias("replica"),
        F.struct(*[F.col(f"lag_{n}").alias(n) for n in names]).alias("sync_lag"),
        *rest,
    )


def with_availability(status: DataFrame, column: str = "ha_status") -> DataFrame:
    """Add the availability label to rows holding ``source_status`` / ``replica_status``."""
    return status.withColumn(column, availability_label(F.col("source_status"), F.col("replica_status")))


def ha_status(
    spark: SparkSession,
    source: Side,
    replica: Side,
    names: Sequence[str],
    checked_at: str | Column | None = None,
    with_checked_at: bool = True,
) -> DataFrame:
    """One row: each side's status, counts, location and error, ``ha_status`` (and ``checked_at``)."""
    status = with_availability(sync_status(spark, source, replica, names, checked_at, with_checked_at))
    return status.select(
        "source_status",
        "replica_status",
        *[f"source_{n}" for n in names],
        *[f"replica_{n}" for n in names],
        _text(source.location).alias("source_location"),
        _text(replica.location).alias("replica_location"),
        "source_error",
        "replica_error",
        "ha_status",
        *(["checked_at"] if with_checked_at else []),
    )
