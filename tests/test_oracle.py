"""Every registered query equals its DuckDB SQL on the sf0.01 test tables."""

from __future__ import annotations

import pytest

from conftest import SF001, SF01
from oracle_compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from ledgerflow.plans.standins import QUERIES

SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(38,2)": "DECIMAL(38,2)",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    result = compare(spark, name, SF01, con)
    assert result["columns_match"], result
    assert result["values_match"], result
    assert result["spark_rows"] == result["oracle_rows"] > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, con, name):
    df = queries()[name](spark, SF001)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    rel = duck(SF001).sql(oracle_sql()[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["customer_name", "email", "total_spent", "rental_count"] and len(rows) == 10
