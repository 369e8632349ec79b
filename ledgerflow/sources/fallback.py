"""Reading from one of several copies of a table set, with provenance.

``read_with_fallback`` tries the copies in order and returns the first
readable one with its name, which callers attach to results as a
``data_source`` column. ``open_side`` opens one copy of a table set and
``ledgerflow.operators.status.count_side`` counts its tables; a copy that
fails at either becomes an offline side carrying the error text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.sources.tables import read_table

# Default copy names used for provenance.
PRIMARY = "primary"
FALLBACK = "fallback"


class NoReadableSource(RuntimeError):
    """No candidate copy could be read; the message keeps every cause."""


def _probe(df: DataFrame) -> None:
    # Reads are lazy: resolve one row so a broken copy fails here, inside the
    # fallback, rather than at the caller's first action.
    df.limit(1).collect()


def read_with_fallback(
    spark: SparkSession,
    candidates: Sequence[tuple[str, str]],
    table: str,
    probe: bool = True,
    schema: T.StructType | None = None,
) -> tuple[DataFrame, str]:
    """Read ``table`` from the first readable ``(name, base_path)`` candidate.

    With a declared ``schema`` a copy that lacks a column or stores it with
    another type is not readable either. Returns the DataFrame and the
    candidate's name. Raises ``NoReadableSource`` listing every candidate's error when none works.
    """
    errors = []
    for name, base in candidates:
        try:
            df = read_table(spark, base, table, schema, validate=schema is not None)
            if probe:
                _probe(df)
            return df, name
        except Exception as exc:  # noqa: BLE001 - any failure means "try the next copy"
            errors.append(f"{name}: {type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}")
    raise NoReadableSource("no readable copy of " + table + " | " + " | ".join(errors))


def with_source(df: DataFrame, name: str, column: str = "data_source") -> DataFrame:
    """Tag every row with the name of the copy it was read from."""
    return df.withColumn(column, F.lit(name))


@dataclass
class Side:
    """One copy of a table set; ``tables`` is empty when the copy is offline, ``counts`` filled when they are taken."""

    name: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None
    location: str | None = None
    counts: dict[str, int] | None = None

    @property
    def online(self) -> bool:
        return self.error is None


def open_side(
    spark: SparkSession,
    name: str,
    base: str | None,
    tables: Mapping[str, str],
    probe: bool = False,
    schemas: Mapping[str, T.StructType] | None = None,
) -> Side:
    """Open ``tables`` (alias -> table name) under ``base``; offline on any failure.

    A missing path is detected while opening. ``schemas`` (table name ->
    declared schema) skips schema inference for those tables. With
    ``probe=True`` one row of each table is also read.
    """
    if base is None:
        return Side(name, error="no location configured")
    try:
        declared = schemas or {}
        frames = {alias: read_table(spark, base, table, declared.get(table)) for alias, table in tables.items()}
        if probe:
            for df in frames.values():
                _probe(df)
        return Side(name, frames, location=base)
    except Exception as exc:  # noqa: BLE001 - an unreadable copy is reported, not raised
        return Side(name, error=first_line(exc), location=base)


def first_line(exc: Exception) -> str:
    return str(exc).splitlines()[0] if str(exc) else type(exc).__name__
