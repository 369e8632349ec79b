"""Whole-table totals gathered into one row.

Each figure is an uncorrelated scalar subquery (partial aggregate per
task, one tiny final aggregate), so the figures are computed in parallel
and no join, cross product or driver-side loop is involved. Counts read
no columns (``ReadSchema: struct<>``); two figures over one table share
one scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.money import money_sum


def count_of(df: DataFrame) -> Column:
    """``COUNT(*)`` of a table as a scalar column."""
    return df.select(F.count(F.lit(1))).scalar()


def money_total_of(df: DataFrame, column: str) -> Column:
    """``ROUND(SUM(column), 2)`` of a table as a scalar DECIMAL(38,2) column."""
    return df.select(money_sum(column, df.schema[column].dataType)).scalar()


def one_row(spark: SparkSession, figures: Mapping[str, Column]) -> DataFrame:
    """One row holding each named scalar figure."""
    return spark.range(1).select(*[column.alias(name) for name, column in figures.items()])


def overview_totals(
    spark: SparkSession,
    counted: Mapping[str, DataFrame],
    revenue: tuple[str, DataFrame, str],
    order: list[str] | None = None,
    data_source: str | None = None,
) -> DataFrame:
    """Row counts of several tables plus one rounded money total, in one row.

    ``counted`` maps output column -> table; ``revenue`` is
    ``(output column, table, money column)``. ``order`` fixes the column
    order; ``data_source`` adds a provenance column.
    """
    revenue_name, revenue_df, revenue_col = revenue
    figures: dict[str, Column] = {name: count_of(df) for name, df in counted.items()}
    figures[revenue_name] = money_total_of(revenue_df, revenue_col)
    names = order or list(figures)
    ordered = {name: figures[name] for name in names}
    if data_source is not None:
        ordered["data_source"] = F.lit(data_source)
    return one_row(spark, ordered)
