"""Top-k with explicit NULL placement and a deterministic tiebreak.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task
keeps its own k best rows and only those reach the final merge, so no
full sort or shuffle of the input happens.

NULL placement follows the SQL the operators reproduce: NULL sorts as the
largest value (first when descending, last when ascending).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def desc(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.desc_nulls_first()


def asc(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.asc_nulls_last()


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of ``df`` in ``order`` (make ``order`` total to be deterministic)."""
    if k <= 0:
        raise ValueError("k must be positive")
    return df.orderBy(*order).limit(k)
