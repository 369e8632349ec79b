"""Helpers shared by the operators of this folder.

Written tables
    ``written`` cuts the lineage by writing a table under the shared folder
    (``spark.checkpoint.dir``) and reading it back, so a lost executor costs
    the tasks of the current step only. The folder is marked for deletion
    when the driver's file system closes.

Column names
    Operators read the columns they are told to and nothing else, so extra
    columns of any name cannot clash; where a whole row must travel along
    (filters of the pipeline) helper columns get names from ``unused``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.session import fresh_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster with the package installed this adds a path that is not there.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in known if p]])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new location under the shared folder, deleted when the driver ends."""
    path = fresh_path(spark, f"llm-{name}")
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder, and read from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a prefix that none of ``df``'s columns starts with."""
    taken = [c.lower() for c in df.columns]
    prefix = "_llm_"
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    return [prefix + n for n in names]


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """A non-null key of (id, whole text): rows that share it are repeats of each other.

    The id is spelled out, the text enters by a 64-bit hash, so two keys can
    only collide within one id.
    """
    return F.concat(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")),
        F.lit(":"),
        F.lower(F.hex(F.xxhash64(text_of(text_col)))),
    )


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``, chosen by a hash of its other columns (but maps).

    ``row_number() = 1`` plans a group limit before the shuffle, so a key that
    fills a third of the rows leaves each task as one row.
    """
    plain = [f.name for f in df.schema.fields if f.name != key and _hashable(f.dataType)]
    order = [F.xxhash64(*[F.col(f"`{c}`") for c in plain])] if plain else [F.lit(0)]
    (rank,) = unused(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(
        F.col(rank) == 1
    ).drop(rank)
