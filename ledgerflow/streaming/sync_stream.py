"""Continuous sync as a Structured Streaming query.

New files in the source location are read as micro-batches; each batch
goes through ``insert_if_absent`` inside ``foreachBatch`` and, optionally,
appends one row of metrics to a log table. The stream's position lives in
the checkpoint, so a restarted query resumes after the last committed
batch; a batch replayed after a failure inserts nothing twice because the
insert skips keys already present, and its log row still tells how many rows
the batch brought (``ledgerflow.operators.sync.logged_insert``).

Batch size is bounded by ``max_files_per_trigger`` / ``max_bytes_per_trigger``
(the file source has no row cap; the row-capped form is
``ledgerflow.operators.sync.run_sync``). The default trigger fires every
30 seconds; ``available_now=True`` processes everything present and stops.

With ``keyed_state`` the keys that the stream has brought are kept in a state
store (RocksDB, on disk; ``dropDuplicates``), so a batch holds only rows whose
key is new, and they are appended without a look at the target. The state is
seeded with the target's keys when the checkpoint is new. Only the first batch
after a start, which may be a replay of one that landed, is compared with the
target. Of rows in one micro-batch that share a key any one is kept, so keys
should be unique at the source (or their rows equal); only this stream may
write to the target, and ``found`` counts new keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.operators.keyed_table import KeyedTable
from ledgerflow.operators.sync import batch_range, insert_if_absent, logged_insert
from ledgerflow.operators.sync_log import BLOCK, CycleResult, append_log, block_of, compact_log, utc_now
from ledgerflow.session import fresh_path, path_exists, session_settings
from ledgerflow.streaming.supervisor import StopGate

DEFAULT_INTERVAL = "30 seconds"
# The state store on disk (a fixed value: Spark's class).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_location(path: str) -> str:
    """A location the file stream source accepts.

    The file source needs a directory or a glob; a single Parquet file is
    turned into a one-element glob of its folder.
    """
    path = path.rstrip("/")
    if path.endswith(".parquet"):
        folder, _, name = path.rpartition("/")
        return f"{folder}/{{{name}}}"
    return path


def start_sync(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType,
    target_path: str,
    key: str,
    checkpoint: str | None = None,
    log_path: str | None = None,
    interval: str = DEFAULT_INTERVAL,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
    order_by: Sequence[str] | None = None,
    with_counts: bool = False,
    query_name: str | None = None,
    keyed_state: bool = False,
    gate: StopGate | None = None,
) -> StreamingQuery:
    """Start streaming ``source_path`` into the Parquet table at ``target_path``.

    ``checkpoint`` defaults to a new folder under the shared folder
    (``spark.checkpoint.dir``); pass the same one to resume. With a
    ``log_path`` each batch appends its metrics; ``with_counts`` adds
    whole-table counts of source and target (and their difference) to it,
    which lists both tables and reads their file footers at every batch. For
    large tables leave it off and take the lag on demand from
    ``ledgerflow.operators.sync_status``. Every batch passes the ``gate``, if
    there is one, before it does anything (``run_supervised``).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    stream = reader.parquet(stream_location(source_path))
    location = checkpoint or fresh_path(spark, "sync-checkpoint")

    if keyed_state:
        stream = _new_keys(spark, stream, target_path, key, f"{location.rstrip('/')}_keys")
    started: list[int] = []

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        if gate is not None:
            gate.enter(batch_id)
        if keyed_state:
            append_new_keys(batch, target_path, key, batch_id, log_path, location, order_by, compare=not started)
            started.append(batch_id)
            return
        # Not cached: the batch is a scan of its new files, so the key-range
        # pass reads only the key column and the insert reads the rest once;
        # caching would hold every column of a possibly large batch.
        session = batch.sparkSession
        if not log_path:
            insert_if_absent(session, batch, target_path, key, order_by)
            return
        counted = (lambda: session.read.schema(schema).parquet(source_path)) if with_counts else None
        logged_insert(session, batch, target_path, key, log_path, location, batch_id, order_by, source=counted)

    writer = (
        stream.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", location)
    )
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with session_settings(spark, **({"spark__sql__streaming__stateStore__providerClass": ROCKSDB} if keyed_state else {})):
        return writer.start()


def _new_keys(spark: SparkSession, stream: DataFrame, target_path: str, key: str, seed_path: str) -> DataFrame:
    """The rows of the stream whose key neither it nor the target (when the checkpoint was new) has had; ``_seed`` marks the latter's."""
    kept = T.StructType([stream.schema[key]])
    if not path_exists(spark, f"{seed_path}/_SUCCESS"):
        there = path_exists(spark, target_path)
        rows = spark.read.schema(stream.schema).parquet(target_path) if there else spark.createDataFrame([], stream.schema)
        rows.select(key).write.mode("overwrite").parquet(seed_path)
    others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in stream.schema.fields]
    seeds = spark.readStream.schema(kept).parquet(seed_path).select(*others, F.lit(True).alias("_seed"))
    rows = stream.withColumn("_seed", F.lit(False)).unionByName(seeds)
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])


def append_new_keys(
    batch: DataFrame,
    target_path: str,
    key: str,
    batch_id: int,
    log_path: str | None = None,
    run: str = "",
    order_by: Sequence[str] | None = None,
    compare: bool = False,
) -> None:
    """Append a micro-batch of ``_new_keys``; ``compare`` it with the target first if it may have landed already.

    The batch is kept while it is worked on, as every action on it would run
    the state operator again. The first batch of a checkpoint may hold the
    target's own keys and is logged like any insert; in a later one all keys
    are new, so it has brought them all, however often it is run.
    """
    spark = batch.sparkSession
    fresh = batch.where(~F.col("_seed")).drop("_seed").persist()
    try:
        known = batch_range(fresh, key)
        if compare and batch_id == 0 and log_path:
            logged_insert(spark, fresh, target_path, key, log_path, run, batch_id, order_by, known_range=known)
            return
        count, low, high = known
        inserted = count
        if compare:
            written = insert_if_absent(spark, fresh, target_path, key, order_by, known).inserted
            inserted = written if batch_id == 0 else count
        elif count:
            keyed = KeyedTable.at(spark, target_path)
            keyed.append(fresh.repartition(keyed.buckets, key)) if keyed else fresh.write.mode("append").parquet(target_path)
        if log_path:
            if batch_id % BLOCK == 0:
                compact_log(spark, log_path, run, block_of(batch_id))
            entry = CycleResult(batch_id, utc_now(), count, low, high, inserted, high, None, None, None, run=run)
            append_log(spark, log_path, entry, batch.schema[key].dataType)
    finally:
        fresh.unpersist()


def sync_until_caught_up(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType,
    target_path: str,
    key: str,
    **options: object,
) -> None:
    """Run ``start_sync`` with ``available_now=True`` and wait for it to finish."""
    query = start_sync(spark, source_path, schema, target_path, key, available_now=True, **options)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
