"""JSON output for query results.

``json_rows`` turns each row into one JSON object on the executors (one
string column ``value``), ready for ``write.text``. Decimals are written
as strings so exact money survives JSON readers that parse numbers as
floats. ``json_document`` wraps a report (a top-k list, a monthly series)
into one ``{"data": [...], "data_source": ...}`` document; what has no
natural bound belongs in ``json_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON_OPTIONS = {"ignoreNullFields": "false"}


def _json_safe_columns(df: DataFrame) -> list[Column]:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return cols


def json_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per row; decimals as strings, NULLs kept as ``null``."""
    return df.select(F.to_json(F.struct(*_json_safe_columns(df)), _JSON_OPTIONS).alias(column))


def json_document(df: DataFrame, data_source: str | None = None, column: str = "value") -> DataFrame:
    """One ``{"data": [...], "data_source": ...}`` document of an ordered report.

    The rows keep the order ``df`` has them in, ties included, whatever it
    was ordered by. The document is one row, packed by one task.
    """
    placed = df.select("*", F.monotonically_increasing_id().alias("_place"))
    row = F.struct(*_json_safe_columns(df))
    packed = placed.agg(F.sort_array(F.collect_list(F.struct(F.col("_place"), row.alias("row")))).alias("_rows"))
    data = F.transform(F.col("_rows"), lambda x: x["row"])
    doc = F.struct(data.alias("data"), F.lit(data_source).cast("string").alias("data_source"))
    return packed.select(F.to_json(doc, _JSON_OPTIONS).alias(column))
