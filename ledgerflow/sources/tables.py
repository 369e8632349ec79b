"""Loading tables with declared schemas.

Tables are Parquet (columnar, filters and projections pushed to the scan).
A JDBC reader with partitioned reads is provided for deployments that
keep the tables in a relational database; it needs the database's JDBC
driver on the classpath.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerflow.schemas import TABLES


class SchemaMismatch(ValueError):
    """A table lacks a declared column or stores it with another type."""


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def check_schema(df: DataFrame, declared: T.StructType, name: str = "table") -> DataFrame:
    """Fail fast when a declared column is missing or has another type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in declared.fields:
        if field.name not in actual:
            problems.append(f"missing {field.name}")
        elif actual[field.name] != field.dataType:
            problems.append(f"{field.name} is {actual[field.name].simpleString()}, "
                            f"declared {field.dataType.simpleString()}")
    if problems:
        raise SchemaMismatch(f"{name}: " + "; ".join(problems))
    return df


def read_table(
    spark: SparkSession,
    base: str,
    name: str,
    schema: T.StructType | None = None,
    validate: bool = False,
) -> DataFrame:
    """Read ``<base>/<name>.parquet``.

    Without ``schema`` the file schema is inferred. With a declared
    ``schema`` Spark skips that inference (a footer-reading job per read);
    use it only for tables known to match, because a declared column the
    files lack reads as NULL. ``validate=True`` infers and checks the file
    schema against ``schema`` instead. Listing the path happens here in every
    case, so a missing table raises immediately.
    """
    path = table_path(base, name)
    if schema is None:
        return spark.read.parquet(path)
    if validate:
        return check_schema(spark.read.parquet(path), schema, name)
    return spark.read.schema(schema).parquet(path)


def load_tables(
    spark: SparkSession,
    base: str,
    names: Iterable[str],
    schemas: Mapping[str, T.StructType] | None = None,
) -> dict[str, DataFrame]:
    """Read several tables from one base folder (declared schemas from ``schemas``)."""
    return {name: read_table(spark, base, name, (schemas or {}).get(name)) for name in names}


def load_test_tables(spark: SparkSession, base: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Read test tables with their declared schemas (``ledgerflow.schemas.TABLES``)."""
    return load_tables(spark, base, names, TABLES)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower_bound: int,
    upper_bound: int,
    num_partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Read a database table in ``num_partitions`` parallel range slices of ``partition_column``.

    Credentials come from ``properties`` supplied by the caller.
    """
    return spark.read.jdbc(
        url=url,
        table=table,
        column=partition_column,
        lowerBound=lower_bound,
        upperBound=upper_bound,
        numPartitions=num_partitions,
        properties=properties or {},
    )
