"""A target table bucketed and sorted by its key.

A Parquet folder whose files are dealt out by a hash of the key: a join on the
key reads it bucket by bucket, so only the other side is shuffled, and its rows
are written back by the task that holds the bucket. ``insert_if_absent``
takes such a table wherever it takes a path.

The declaration (key, number of buckets, schema) is stored beside the files,
in a folder that Spark's readers skip, so any session can open the table by its
path; plain readers see an ordinary Parquet table. A batch adds at most one
file to each bucket. ``rewritten`` gives a table of one file per bucket.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerflow.session import path_exists, session_settings

DECLARATION = "_keyed"
# Rows per bucket, when the number of buckets is taken from an expected size.
ROWS_PER_BUCKET = 2_000_000
# Spark takes 100,000 buckets at most; beyond this buckets hold more rows.
MOST_BUCKETS = 65_536


def buckets_for(rows: int) -> int:
    """A power of two from 8 to ``MOST_BUCKETS``, for about ``ROWS_PER_BUCKET`` rows in a bucket."""
    return min(MOST_BUCKETS, max(8, 1 << (max(1, rows // ROWS_PER_BUCKET) - 1).bit_length()))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class KeyedTable:
    """A bucketed table at ``path``, known to the session's catalog as ``table``."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: T.StructType
    table: str

    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> KeyedTable:
        """Declare a new, empty table at ``path``."""
        if path_exists(spark, path):
            raise ValueError(f"{path} is there already")
        declared = [(key, buckets, schema.json())]
        spark.createDataFrame(declared, "key string, buckets int, fields string").coalesce(1).write.json(f"{path}/{DECLARATION}")
        return KeyedTable._registered(spark, path, schema, key, buckets)

    @staticmethod
    def at(spark: SparkSession, path: str) -> KeyedTable | None:
        """The table declared at ``path``; None if there is none."""
        declaration = f"{path.rstrip('/')}/{DECLARATION}"
        if not path_exists(spark, declaration):
            return None
        row = spark.read.schema("key string, buckets int, fields string").json(declaration).first()
        schema = T.StructType.fromJson(json.loads(row["fields"]))
        return KeyedTable._registered(spark, path, schema, row["key"], row["buckets"])

    @staticmethod
    def _registered(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> KeyedTable:
        table = f"keyed_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        return KeyedTable(spark, path, key, buckets, schema, table)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def exchanges_as_bucketed(self) -> contextlib.AbstractContextManager[None]:
        """Jobs started inside deal rows out to as many tasks as there are buckets, so that they meet the table unshuffled."""
        return session_settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets))

    def append(self, rows: DataFrame) -> None:
        """Append rows, by column name; those of a bucket should be in one task (else it gets several files)."""
        rows.select(*[_quoted(f.name) for f in self.schema.fields]).write.insertInto(self.table)

    def rewritten(self, path: str, buckets: int | None = None) -> KeyedTable:
        """A copy at another path with one file per bucket; without a change of buckets nothing is shuffled."""
        copy = KeyedTable.create(self.spark, path, self.schema, self.key, buckets or self.buckets)
        if copy.buckets != self.buckets:
            copy.append(self.rows().repartition(copy.buckets, self.key))
            return copy
        # Without an operator that asks for buckets the scan would not keep to them.
        with session_settings(self.spark, spark__sql__sources__bucketing__autoBucketedScan__enabled="false"):
            copy.append(self.rows())
        return copy

    def forget(self) -> None:
        """Drop the table's name from the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
