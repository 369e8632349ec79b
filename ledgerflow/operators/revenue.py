"""Monthly revenue over a plain fact table or a month-partitioned copy.

Grouping by month is a partial aggregate per task (at most one row per
month per task leaves the task) and a tiny final aggregate; months
without rows are absent and a NULL date forms its own group, sorted last.

The month-partitioned layout stores the ``yyyy-MM`` key as a directory
partition column. Filtering on that column prunes directories
(``PartitionFilters`` in the scan); filtering on an expression of the
timestamp would not. The writer uses a REBALANCE on the month: AQE sizes
the write partitions to ``spark.sql.adaptive.advisoryPartitionSizeInBytes``,
splitting a month that holds a large share of the rows over many tasks
and files and merging small months, instead of one task per month or one
file per (task, month).

``refresh_month_partitioned`` keeps such a copy up to date: a digest of every
month's rows is stored beside the layout, and only months whose digest has
changed are written again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.functions.money import money_sum, month_key
from ledgerflow.operators.topk import asc
from ledgerflow.session import delete_path, path_exists

# Digests of the months, in a folder of the layout that Spark's readers skip.
DIGESTS = "_months"
DIGEST_SCHEMA = "month string, rows long, total decimal(38,0), mixed long"
# How Spark names the folder of a null partition value (a fixed value).
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def monthly_revenue(
    payment: DataFrame,
    *,
    date_col: str,
    amount: str,
    payment_id: str,
    month_as: str = "month",
    revenue_as: str = "revenue",
    count_as: str = "payment_count",
) -> DataFrame:
    """Per calendar month: rounded money total and count of non-null ids, by month."""
    amount_type = payment.schema[amount].dataType
    return (
        payment.groupBy(month_key(date_col).alias(month_as))
        .agg(money_sum(amount, amount_type).alias(revenue_as), F.count(F.col(payment_id)).alias(count_as))
        .orderBy(asc(month_as))
    )


def write_month_partitioned(
    df: DataFrame,
    path: str,
    *,
    date_col: str,
    key_col: str | None = None,
    month_col: str = "month",
    mode: str = "overwrite",
    replace_months_only: bool = False,
) -> None:
    """Write ``df`` under ``path`` partitioned by the ``yyyy-MM`` month of ``date_col``.

    Rows are sorted by (month, date, key) inside each task, so Parquet
    min/max statistics of the date and key columns are tight per file.
    ``replace_months_only=True`` (with ``mode="overwrite"``) replaces only
    the months present in ``df`` and keeps the others, for loading a month
    at a time. Stored month digests no longer hold then and are deleted.
    """
    delete_path(df.sparkSession, _digest_path(path))
    _write_months(df, path, date_col, key_col, month_col, mode, replace_months_only)


def _write_months(
    df: DataFrame, path: str, date_col: str, key_col: str | None, month_col: str, mode: str, replace_months_only: bool
) -> None:
    order = [month_col, date_col] + ([key_col] if key_col else [])
    writer = (
        df.withColumn(month_col, month_key(date_col))
        .hint("rebalance", month_col)
        .sortWithinPartitions(*order)
        .write.mode(mode)
    )
    if replace_months_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(month_col).parquet(path)


def _digest_path(path: str) -> str:
    return f"{path.rstrip('/')}/{DIGESTS}"


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def month_digests(df: DataFrame, date_col: str, month_col: str = "month") -> DataFrame:
    """(month, rows, total, mixed): what the rows of each month come to, whatever their order and files.

    A row's hash covers its columns in the order of their names, with a mark
    for nulls; the sum of one hash and the exclusive or of another are taken
    with the count, by partial aggregates: a row per month leaves each task.
    """
    parts: list[Column] = []
    for f in sorted((f for f in df.schema.fields if f.name != month_col), key=lambda f: f.name):
        col = F.col(f"`{f.name}`")
        parts += [col.isNull(), F.to_json(F.struct(col)) if _has_map(f.dataType) else col]
    return df.groupBy(month_key(date_col).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"),
        F.bit_xor(F.xxhash64(F.lit(2), *parts)).alias("mixed"),
    )


def _in_months(date_col: str, months: Iterable[str | None], kind: T.DataType) -> Column:
    """Rows of these months; their span in time is a filter that Parquet statistics can use."""
    dated = sorted(m for m in months if m is not None)
    wanted = F.lit(False)
    if dated:
        first, last = (F.to_date(F.lit(f"{m}-01")) for m in (dated[0], dated[-1]))
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            span = (F.col(date_col) >= first.cast(kind)) & (F.col(date_col) < F.add_months(last, 1).cast(kind))
        else:
            span = F.lit(True)
        wanted = span & month_key(date_col).isin(dated)
    return wanted | F.col(date_col).isNull() if None in months else wanted


@dataclass(frozen=True)
class MonthRefresh:
    """What a refresh did: months written (again), months removed, months left as they were."""

    written: list[str | None]
    removed: list[str | None]
    kept: int


def refresh_month_partitioned(
    df: DataFrame, path: str, *, date_col: str, key_col: str | None = None, month_col: str = "month"
) -> MonthRefresh:
    """Make the layout at ``path`` hold the rows of ``df``, writing only months that have changed.

    One pass takes the months' digests; a row per month reaches the driver.
    The stored digests of changed months are taken away before their data is
    touched and written anew at the end, so a refresh that is lost in between
    does those months again. A folder without digests is written whole.
    """
    spark = df.sparkSession
    wanted = {r["month"]: tuple(r) for r in month_digests(df, date_col, month_col).collect()}
    stored: dict[str | None, tuple] | None = None
    if path_exists(spark, f"{_digest_path(path)}/_SUCCESS"):
        stored = {r["month"]: tuple(r) for r in spark.read.schema(DIGEST_SCHEMA).parquet(_digest_path(path)).collect()}

    def store(rows: Iterable[tuple]) -> None:
        digests = spark.createDataFrame(list(rows), DIGEST_SCHEMA).coalesce(1)
        digests.write.mode("overwrite").parquet(_digest_path(path))

    def in_order(months: Iterable[str | None]) -> list[str | None]:
        return sorted(months, key=lambda m: (m is None, m or ""))

    if stored is None:
        _write_months(df, path, date_col, key_col, month_col, "overwrite", False)
        store(wanted.values())
        return MonthRefresh(in_order(wanted), [], 0)
    same = {m for m, digest in wanted.items() if stored.get(m) == digest}
    changed, gone = in_order(wanted.keys() - same), in_order(stored.keys() - wanted.keys())
    if not changed and not gone:
        return MonthRefresh([], [], len(same))
    store(wanted[m] for m in same)
    if changed:
        rows = df.where(_in_months(date_col, changed, df.schema[date_col].dataType))
        _write_months(rows, path, date_col, key_col, month_col, "overwrite", True)
    for month in gone:
        delete_path(spark, f"{path.rstrip('/')}/{month_col}={NULL_PARTITION if month is None else month}")
    store(wanted.values())
    return MonthRefresh(changed, gone, len(same))


def read_month_partitioned(
    spark: SparkSession, path: str, schema: T.StructType, month_col: str = "month"
) -> DataFrame:
    """Read the layout back with the month as a string partition column."""
    fields = [f for f in schema.fields if f.name != month_col]
    full = T.StructType(fields + [T.StructField(month_col, T.StringType(), True)])
    return spark.read.schema(full).parquet(path)


def monthly_revenue_partitioned(
    partitioned: DataFrame,
    *,
    amount: str,
    payment_id: str,
    month_col: str = "month",
    months: tuple[str, str] | None = None,
    revenue_as: str = "revenue",
    count_as: str = "payment_count",
) -> DataFrame:
    """Monthly revenue grouped on the stored month column.

    ``months=(first, last)`` keeps only that inclusive range of ``yyyy-MM``
    keys, pruned at the directory level.
    """
    df = partitioned
    if months is not None:
        df = df.where(F.col(month_col).between(months[0], months[1]))
    amount_type = df.schema[amount].dataType
    return (
        df.groupBy(F.col(month_col))
        .agg(money_sum(amount, amount_type).alias(revenue_as), F.count(F.col(payment_id)).alias(count_as))
        .orderBy(asc(month_col))
    )
