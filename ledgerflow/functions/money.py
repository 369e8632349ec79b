"""Exact money totals, month keys and timestamps.

Money is summed as DECIMAL so totals do not depend on the order in which
partial sums meet, and rounded to cents once, after the sum (half away from
zero). Decimal inputs are summed at their own scale; doubles, whose sums in
arbitrary order are not exact, at eight decimal places. Totals are
DECIMAL(38,2) so a sum over a very large fact cannot overflow the result
type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Of doubles before the sum: 30 digits before the point, eight after it.
WIDE = T.DecimalType(38, 8)
TOTAL = T.DecimalType(38, 2)

# Fixed output format of timestamps.
STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def money_value(column: str | Column, dtype: T.DataType) -> Column:
    """One money value as a decimal to be summed (doubles to eight decimal places)."""
    col = F.col(column) if isinstance(column, str) else column
    return col if isinstance(dtype, T.DecimalType) else col.cast(WIDE)


def money_sum(column: str | Column, dtype: T.DataType) -> Column:
    """``ROUND(SUM(x), 2)`` as DECIMAL(38,2); NULL when no non-null input."""
    return F.round(F.sum(money_value(column, dtype)), 2).cast(TOTAL)


def round_total(column: str | Column) -> Column:
    """Round an already summed decimal to cents as DECIMAL(38,2)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 2).cast(TOTAL)


def month_key(column: str | Column) -> Column:
    """Calendar month of a timestamp or date as ``yyyy-MM`` (NULL stays NULL).

    Built from ``year`` and ``month``, which read a TIMESTAMP_NTZ's wall
    clock directly; formatting would first convert it through the session
    time zone, where a daylight-saving gap can move a value across midnight.
    """
    col = F.col(column) if isinstance(column, str) else column
    return F.when(col.isNotNull(), F.format_string("%04d-%02d", F.year(col), F.month(col)))


def utc_stamp(at: str | Column | None = None) -> Column:
    """A UTC time as ``yyyy-MM-ddTHH:mm:ssZ``; the current time when ``at`` is None.

    ``at`` (a UTC wall-clock string or column) makes results repeatable. The
    current time is shifted from the session time zone to UTC before
    formatting, so the ``Z`` holds whatever the session zone is.
    """
    if at is None:
        ts = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    elif isinstance(at, str):
        ts = F.to_timestamp(F.lit(at))
    else:
        ts = at
    return F.date_format(ts, STAMP_FORMAT)
