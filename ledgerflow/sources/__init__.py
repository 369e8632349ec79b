"""Sources and sinks: Parquet/JDBC tables, fallback copies, JSON rows."""

from ledgerflow.sources.fallback import (
    FALLBACK,
    PRIMARY,
    NoReadableSource,
    Side,
    open_side,
    read_with_fallback,
    with_source,
)
from ledgerflow.sources.sinks import json_document, json_rows
from ledgerflow.sources.tables import (
    SchemaMismatch,
    check_schema,
    load_tables,
    load_test_tables,
    read_jdbc_table,
    read_table,
    table_path,
)

__all__ = [
    "FALLBACK",
    "PRIMARY",
    "NoReadableSource",
    "Side",
    "open_side",
    "read_with_fallback",
    "with_source",
    "json_document",
    "json_rows",
    "SchemaMismatch",
    "check_schema",
    "load_tables",
    "load_test_tables",
    "read_jdbc_table",
    "read_table",
    "table_path",
]
