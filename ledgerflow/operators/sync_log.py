"""Log of sync cycles and micro-batches: an intent row before the write, a result row after it, failures in between.

A stream is one run for ever, so the log must stay cheap however long it gets.
It is partitioned by run and by block of ``BLOCK`` cycles; what a cycle needs
to know is in its own block, whose folder is read by name, so a cycle lists and
opens at most two files a cycle of its block (and one a failure), whatever the
log holds. The first cycle of a block compacts the finished ones before: their
results and failures go into one file under the block's negative number, then
the block's many files are deleted. A process lost in between leaves both;
readers drop the equal rows.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.session import delete_path, names_in, path_exists

# Cycles of a run that share a folder of the log.
BLOCK = 50

INTENT, RESULT, FAILURE = "intent", "result", "failure"


def log_schema(key_type: T.DataType) -> T.StructType:
    """Schema of a log whose key columns have the type of the synced key."""
    long = T.LongType()
    return T.StructType(
        [
            T.StructField("cycle", long, False),
            T.StructField("logged_at", T.TimestampNTZType(), False),  # UTC wall clock
            T.StructField("found", long, False),
            T.StructField("first_key", key_type, True),
            T.StructField("last_key", key_type, True),
            T.StructField("inserted", long, True),
            T.StructField("watermark", key_type, True),
            T.StructField("source_count", long, True),  # NULL: not asked for, or the side is unreadable
            T.StructField("target_count", long, True),
            T.StructField("remaining_lag", long, True),
            T.StructField("stage", T.StringType(), False),
            T.StructField("range_before", long, True),  # target rows in the batch's key range before the write
            T.StructField("error", T.StringType(), True),  # what ended a failed attempt
            T.StructField("run", T.StringType(), True),  # one run_sync call, or a stream's checkpoint
        ]
    )


@dataclass
class CycleResult:
    cycle: int
    logged_at: _dt.datetime
    found: int
    first_key: object
    last_key: object
    inserted: int | None
    watermark: object
    source_count: int | None
    target_count: int | None
    remaining_lag: int | None
    stage: str = RESULT
    range_before: int | None = None
    error: str | None = None
    run: str | None = None


def utc_now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def block_of(cycle: int) -> int:
    return cycle // BLOCK


def compacted(block: int) -> int:
    """The partition that holds a block once it is compacted."""
    return -1 - block


def run_folder(run: str) -> str:
    """The name of a run's folder: as Spark names partitions, with these characters as %XX."""
    # What partition folder names escape, besides control characters.
    escaped = "\"#%'*/:=?\\\x7f{[]^"
    return "run=" + "".join(f"%{ord(c):02X}" if c in escaped or c < " " else c for c in run)


def append_log(spark: SparkSession, log_path: str, entry: CycleResult, key_type: T.DataType) -> None:
    """Append one row to its run's block."""
    row = spark.createDataFrame([tuple(asdict(entry).values())], log_schema(key_type))
    row = row.withColumn("block", F.lit(block_of(entry.cycle)))
    row.coalesce(1).write.mode("append").partitionBy("run", "block").parquet(log_path)


def _log_rows(spark: SparkSession, log_path: str) -> DataFrame:
    found = spark.read.parquet(log_path).schema
    # The run is text, whatever its partition folders' names look like.
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "run" else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The log's result rows."""
    rows = _log_rows(spark, log_path).where(F.col("stage") == RESULT)
    return rows.drop("block").dropDuplicates().drop("stage", "range_before", "error")


def read_failures(spark: SparkSession, log_path: str) -> DataFrame:
    """The log's failed attempts: cycle, logged_at, error, run."""
    rows = _log_rows(spark, log_path).where(F.col("stage") == FAILURE)
    return rows.select("cycle", "logged_at", "error", "run").dropDuplicates()


def _block_rows(spark: SparkSession, log_path: str, run: str, block: int, schema: T.StructType | str | None = None) -> DataFrame | None:
    """The rows of a block of one run, read from its folders alone; None if there are none."""
    base = log_path.rstrip("/")
    folders = [f"{base}/{run_folder(run)}/block={b}" for b in (block, compacted(block))]
    folders = [f for f in folders if path_exists(spark, f)]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*folders) if folders else None


def logged_stages(spark: SparkSession, log_path: str, run: str, cycle: int) -> dict[str, int | None]:
    """Stage -> range_before of what the log has of one cycle; only the folder of the cycle's block is read."""
    rows = _block_rows(spark, log_path, run, block_of(cycle), "cycle long, stage string, range_before long")
    if rows is None:
        return {}
    wanted = rows.where((F.col("cycle") == cycle) & (F.col("stage") != FAILURE)).select("stage", "range_before").distinct()
    return {r["stage"]: r["range_before"] for r in wanted.collect()}  # two rows at most


def compact_log(spark: SparkSession, log_path: str, run: str, before: int) -> list[int]:
    """Compact the run's blocks below block ``before`` that are not yet; returns them.

    Results and failures stay, and intents of cycles that have no result.
    """
    base = f"{log_path.rstrip('/')}/{run_folder(run)}"
    numbers = [int(n.removeprefix("block=")) for n in names_in(spark, base) or [] if n.startswith("block=")]
    done = sorted(b for b in numbers if 0 <= b < before)
    for block in done:
        rows = spark.read.parquet(f"{base}/block={block}")
        results = rows.where(F.col("stage") == RESULT).select("cycle").distinct()
        kept = rows.where(F.col("stage") != INTENT).unionByName(
            rows.where(F.col("stage") == INTENT).join(F.broadcast(results), "cycle", "left_anti").select(*rows.columns)
        )  # BLOCK rows are broadcast
        kept = kept.withColumn("run", F.lit(run)).withColumn("block", F.lit(compacted(block)))
        kept.coalesce(1).write.mode("append").partitionBy("run", "block").parquet(log_path)
        delete_path(spark, f"{base}/block={block}")
    return done


def log_failure(
    spark: SparkSession, log_path: str, run: str, cycle: int, error: str, key_type: T.DataType
) -> None:
    """Append a failed attempt at a cycle."""
    entry = CycleResult(cycle, utc_now(), 0, None, None, None, None, None, None, None, FAILURE, None, error, run)
    append_log(spark, log_path, entry, key_type)
