"""Incremental, idempotent copy of a keyed table into a target table.

Primitives:
    high_watermark    highest key already in the target (with a default)
    incremental_batch source rows above a watermark, optionally up to a number of rows
    first_per_key     one row per key, by a stated order with NULLs last
    insert_if_absent  append the rows whose key the target lacks
    sync_cycle        one cycle: batch -> insert -> new watermark
    run_sync          cycles until the source has nothing above the watermark

insert_if_absent is the "insert, skip on key conflict" write expressed as
a Spark job: keep one row per key in the batch, anti-join against the
target's keys, append. Replaying a batch therefore inserts nothing, so a
failed or repeated cycle never duplicates rows. The target read is limited
to the batch's key range, which Parquet min/max statistics turn into
skipped files for the usual case of keys above everything in the target.

A cycle copies everything above the watermark unless a cap is asked for.
A cap only decides where a batch ends: rows that repeat a key stay in one
batch, and the row that wins is chosen by the same order, so the target is
the same whatever the cap.

The watermark only moves after the write has committed; a failing write
raises and the next run starts from the same position. With no default
(``init=None``) an empty target means "no lower bound", so a key of 0 or
below is still copied.

A Parquet target has no unique constraint: these functions assume one
writer per target at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators.keyed_table import KeyedTable
from ledgerflow.operators.sync_log import (
    BLOCK,
    INTENT,
    RESULT,
    CycleResult,
    append_log,
    block_of,
    compact_log,
    logged_stages,
    utc_now,
)
from ledgerflow.session import delete_path, names_in, path_exists, temporary_path


def high_watermark(target: DataFrame, key: str, init: object = None, alias: str = "high_watermark") -> DataFrame:
    """One row: ``COALESCE(MAX(key), init)`` over the target; the key column is scanned, NULL keys skipped."""
    top = F.max(F.col(key))
    if init is not None:
        top = F.coalesce(top, F.lit(init))
    return target.where(F.col(key).isNotNull()).agg(top.alias(alias))


def high_watermark_value(target: DataFrame, key: str, init: object = None) -> object:
    """The watermark as a Python value (a single aggregated value reaches the driver)."""
    return high_watermark(target, key, init).first()[0]


def incremental_batch(
    source: DataFrame,
    key: str,
    since: object = None,
    limit: int | None = None,
    columns: Sequence[str] | None = None,
    up_to: object = None,
) -> DataFrame:
    """Rows with ``key > since``; with a ``limit`` up to the limit-th smallest key, in key order.

    ``up_to`` is a last key that is known already (see ``batch_edges``).

    Rows that repeat the last key all belong to the batch, so with repeated
    keys it can hold more than ``limit`` rows. ``since=None`` means no lower
    bound (rows with a NULL key are never part of a batch). The literal
    bounds are pushed to the Parquet scan.
    """
    df = source.select(*(columns or source.columns))
    df = df.where(F.col(key).isNotNull() if since is None else F.col(key) > F.lit(since))
    if up_to is not None:
        df = df.where(F.col(key) <= F.lit(up_to))
    if limit is None:
        return df
    # The limit-th smallest key is found on the key column alone (a per-task
    # top-k); then only rows up to it are read in full. Both bounds are
    # literals, so Parquet statistics skip row groups outside the range.
    upper = df.select(key).orderBy(F.col(key).asc()).limit(limit).agg(F.max(F.col(key))).first()[0]
    if upper is None:
        return df.where(F.lit(False))
    return df.where(F.col(key) <= F.lit(upper)).orderBy(F.col(key).asc())


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _place(df: DataFrame, key: str, order_by: Sequence[str] | None) -> Column | None:
    """What rows of one key are ordered by: ``order_by``, then all other orderable columns, NULLs last."""
    explicit = [c for c in (order_by or []) if c != key]
    rest = [f.name for f in df.schema.fields if f.name != key and f.name not in explicit and _orderable(f.dataType)]
    parts = [p for c in explicit + rest for p in (F.col(c).isNull(), F.col(c))]
    return F.struct(*[p.alias(f"_{i}") for i, p in enumerate(parts)]) if parts else None


def first_per_key(batch: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per non-null key: the first by ``order_by``, then by the other columns, NULLs last.

    ``min_by`` is an ordinary aggregate with a map-side partial step, so a
    key repeated in a large share of the batch is reduced inside each task
    before the shuffle, never gathered into one task. Columns without an
    order (maps) travel with the chosen row.
    """
    keyed = batch.where(F.col(key).isNotNull())
    others = [c for c in batch.columns if c != key]
    if not others:
        return keyed.select(key).distinct()
    place, row = _place(batch, key, order_by), F.struct(*[F.col(c) for c in others])
    picked = keyed.groupBy(key).agg((F.min_by(row, place) if place is not None else F.first(row)).alias("_first"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in batch.columns])


@dataclass
class InsertResult:
    inserted: int
    batch_rows: int
    first_key: object
    last_key: object


def batch_range(batch: DataFrame, key: str) -> tuple[int, object, object]:
    """(rows, smallest key, largest key) of the rows with a key: one pass over the key column, no shuffle."""
    row = batch.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)), F.min(F.col(key)), F.max(F.col(key))).first()
    return int(row[0]), row[1], row[2]


def rows_between(df: DataFrame, key: str, low: object, high: object) -> DataFrame:
    return df.where(F.col(key).between(F.lit(low), F.lit(high)))


def absent_rows(
    batch: DataFrame, existing: DataFrame, key: str, order_by: Sequence[str] | None = None, join: str | None = None
) -> DataFrame:
    """The first row of each of the batch's keys that ``existing`` lacks.

    The aggregate's partitioning by key also serves the anti-join, so the
    batch is shuffled once. ``join`` names a join strategy (a hint).
    """
    known = existing.select(key)
    return first_per_key(batch, key, order_by).join(known.hint(join) if join else known, key, "left_anti")


def insert_if_absent(
    spark: SparkSession,
    batch: DataFrame,
    target_path: str,
    key: str,
    order_by: Sequence[str] | None = None,
    known_range: tuple[int, object, object] | None = None,
) -> InsertResult:
    """Append to the Parquet table at ``target_path`` the batch rows whose key it lacks.

    Within the batch the first row per key wins (``first_per_key``). Returns
    the number of rows written (an observed metric of the write itself, so
    the batch is not recounted) plus the batch's size and key range
    (``known_range``, if the caller has taken it already).

    The batch is shuffled once. A batch whose key range is free in the target
    is not joined to it; one that overlaps meets the target's keys in its range
    in one anti-join. If that leaves nothing, the empty file that the write
    made is taken away again. A ``KeyedTable`` at the path is not shuffled
    either, and looked at once.
    """
    count, low, high = known_range or batch_range(batch, key)
    if not count:
        return InsertResult(0, 0, None, None)
    keyed = KeyedTable.at(spark, target_path)
    if keyed is not None:
        existing = rows_between(keyed.rows(), key, low, high)
        with keyed.exchanges_as_bucketed():
            inserted = _observed(absent_rows(batch, existing, key, order_by, join="merge"), keyed.append)
        return InsertResult(inserted, count, low, high)
    rows, names = first_per_key(batch, key, order_by), None
    if path_exists(spark, target_path):
        existing = rows_between(spark.read.schema(batch.schema).parquet(target_path), key, low, high).select(key)
        if not existing.isEmpty():
            rows, names = absent_rows(batch, existing, key, order_by), names_in(spark, target_path)
    inserted = _observed(rows, lambda df: df.write.mode("append").parquet(target_path))
    if not inserted and names is not None:  # one writer per target: what is new there is the empty file
        for name in set(names_in(spark, target_path)) - set(names):
            delete_path(spark, f"{target_path.rstrip('/')}/{name}")
    return InsertResult(inserted, count, low, high)


def _observed(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """The number of rows written, as the write itself counts them."""
    observation = Observation("insert_if_absent")
    write(rows.observe(observation, F.count(F.lit(1)).alias("inserted")))
    return int(observation.get["inserted"])


def count_or_none(open_table: Callable[[], DataFrame]) -> int | None:
    """A table's row count; None when it cannot be read."""
    try:
        return open_table().count()
    except Exception:  # noqa: BLE001 - an unreadable side has no count; the log says so by NULL
        return None


def side_counts(
    spark: SparkSession, source: Callable[[], DataFrame], target_path: str, schema: T.StructType
) -> tuple[int | None, int | None, int | None]:
    """(source rows, target rows, difference); None for a side that cannot be read, and for the difference then."""
    source_count = count_or_none(source)
    missing = not path_exists(spark, target_path)
    target_count = 0 if missing else count_or_none(lambda: spark.read.schema(schema).parquet(target_path))
    lag = None if source_count is None or target_count is None else source_count - target_count
    return source_count, target_count, lag


def logged_insert(
    spark: SparkSession,
    batch: DataFrame,
    target_path: str,
    key: str,
    log_path: str,
    run: str,
    cycle: int,
    order_by: Sequence[str] | None = None,
    previous_watermark: object = None,
    source: Callable[[], DataFrame] | None = None,
    known_range: tuple[int, object, object] | None = None,
) -> CycleResult | None:
    """``insert_if_absent`` with an intent row before the write and a result row after it.

    A cycle whose result is logged is not run again (None). If only its
    intent is logged, the process was lost in between: the rows may or may
    not have landed, so ``inserted`` is what the batch's key range holds now
    minus what the intent says it held. ``source`` asks for the counts of
    both sides.
    """
    key_type = batch.schema[key].dataType
    stages = logged_stages(spark, log_path, run, cycle)
    if RESULT in stages:
        return None
    if cycle % BLOCK == 0 and not stages:
        compact_log(spark, log_path, run, block_of(cycle))
    count, low, high = known_range or batch_range(batch, key)

    def in_range() -> int:
        if not count or not path_exists(spark, target_path):
            return 0
        return rows_between(spark.read.schema(batch.schema).parquet(target_path), key, low, high).count()

    watermark = high if count else previous_watermark
    if INTENT in stages:
        before = stages[INTENT] or 0
    else:
        before = in_range()
        intent = CycleResult(cycle, utc_now(), count, low, high, None, watermark, None, None, None, INTENT, before, run=run)
        append_log(spark, log_path, intent, key_type)
    written = insert_if_absent(spark, batch, target_path, key, order_by, (count, low, high))
    inserted = in_range() - before if INTENT in stages else written.inserted
    counts = side_counts(spark, source, target_path, batch.schema) if source is not None else (None, None, None)
    result = CycleResult(cycle, utc_now(), count, low, high, inserted, watermark, *counts, RESULT, before, run=run)
    append_log(spark, log_path, result, key_type)
    return result


def batch_edges(source: DataFrame, key: str, cap: int, since: object = None) -> DataFrame:
    """(batch, first_key, last_key, rows): where each batch of ``cap`` rows above ``since`` ends, found in one pass.

    The key column is scanned once. Keys are counted (a repeated key leaves
    each task as one row), dealt out by range and sorted; each range's total
    gives the rows before the next one, and running counts within a range the
    rest. A key belongs to the batch that the number of rows before it says, so
    rows that repeat a key stay together. Written, as planned batches must not
    change between cycles; a row per batch.
    """
    spark = source.sparkSession
    keys = source.select(F.col(key).alias("key"))
    keys = keys.where(F.col("key").isNotNull() if since is None else F.col("key") > F.lit(since))
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    path = temporary_path(spark, "batch-keys")
    ranges = counted.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    ranges.write.parquet(path)
    ranges = spark.read.schema(ranges.schema).parquet(path)
    before, offsets = 0, []
    for part in sorted(ranges.groupBy("part").agg(F.sum("rows").alias("rows")).collect()):  # a row per range
        offsets.append((part["part"], before))
        before += part["rows"]
    earlier = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranges.withColumn("within", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
        .withColumn("batch", F.floor((F.col("before") + F.col("within")) / F.lit(cap)).cast("long"))
    )
    edges = placed.groupBy("batch").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum("rows").alias("rows"))
    path = temporary_path(spark, "batch-edges")
    edges.write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path)


def _cycle(
    spark: SparkSession,
    source: DataFrame,
    batch: DataFrame,
    target_path: str,
    key: str,
    watermark: object,
    cycle: int,
    order_by: Sequence[str] | None,
    with_counts: bool,
    run: str,
    log_path: str | None,
    known_range: tuple[int, object, object] | None = None,
) -> CycleResult:
    """Insert one batch; counts of both sides (and their difference) are taken after the write when ``with_counts``."""
    if log_path:
        return logged_insert(
            spark, batch, target_path, key, log_path, run, cycle, order_by, watermark,
            (lambda: source) if with_counts else None, known_range,
        )
    res = insert_if_absent(spark, batch, target_path, key, order_by, known_range)
    counts = side_counts(spark, lambda: source, target_path, source.schema) if with_counts else (None, None, None)
    new_watermark = res.last_key if res.batch_rows else watermark
    return CycleResult(
        cycle, utc_now(), res.batch_rows, res.first_key, res.last_key, res.inserted, new_watermark, *counts, run=run
    )


def sync_cycle(
    spark: SparkSession,
    source: DataFrame,
    target_path: str,
    key: str,
    watermark: object,
    cap: int | None = None,
    cycle: int = 1,
    order_by: Sequence[str] | None = None,
    with_counts: bool = True,
    run: str | None = None,
    log_path: str | None = None,
) -> CycleResult:
    """One cycle: fetch the rows above ``watermark`` (``cap`` keys' worth, if given), insert the absent ones.

    The new watermark is the last key fetched, or the old one when nothing
    was found.
    """
    batch = incremental_batch(source, key, watermark, cap)
    return _cycle(
        spark, source, batch, target_path, key, watermark, cycle, order_by, with_counts, run or uuid.uuid4().hex, log_path
    )


def _planned(
    load: Callable[[], DataFrame], fixed: bool, key: str, cap: int, start: object
) -> Iterator[tuple[DataFrame, DataFrame, tuple[int, object, object] | None]]:
    """(source, batch, what is known of it) of each capped cycle, the last one empty.

    A snapshot is planned once, whole. A source that may grow is planned anew
    when the full batches of a plan are used up.
    """
    watermark = start
    while True:
        source = load()
        edges = batch_edges(source, key, cap, watermark)
        any_edge = False
        # An edge at a time reaches the driver, which runs a cycle for each.
        for edge in edges.orderBy("batch").toLocalIterator():
            if any_edge and not fixed and edge["rows"] < cap:
                break  # the remainder; more may have landed since
            any_edge = True
            source = source if fixed else load()
            known = (edge["rows"], edge["first_key"], edge["last_key"])
            yield source, incremental_batch(source, key, watermark, up_to=edge["last_key"]), known if fixed else None
            watermark = edge["last_key"]
        if fixed or not any_edge:
            yield source, source.where(F.lit(False)), (0, None, None)
            return


def run_sync(
    spark: SparkSession,
    source: DataFrame | Callable[[], DataFrame],
    target_path: str,
    key: str,
    cap: int | None = None,
    init: object = None,
    log_path: str | None = None,
    order_by: Sequence[str] | None = None,
    with_counts: bool = True,
) -> list[CycleResult]:
    """Run cycles until one finds nothing; returns each cycle's result.

    Uncapped, one cycle copies the backlog and the next finds nothing (or
    what landed meanwhile). ``source`` is a DataFrame (a snapshot: its file
    listing is fixed when it is created) or a function returning one, called
    at every cycle so rows that land during the run are picked up. With a cap
    the batches of the backlog are planned in one pass over its keys
    (``batch_edges``), not searched for in every cycle.

    The watermark is read from the target once, at the start; afterwards it
    only advances to the last key of each written batch, so keys written to
    the target by someone else cannot make this run skip source rows.
    """
    fixed = not callable(source)
    load = (lambda: source) if fixed else source
    watermark = init
    if path_exists(spark, target_path):
        watermark = high_watermark_value(spark.read.schema(load().schema).parquet(target_path), key, init)
    run = uuid.uuid4().hex
    results: list[CycleResult] = []
    planned = _planned(load, fixed, key, cap, watermark) if cap else None
    while not results or results[-1].found:
        if planned is None:
            given, known = load(), None
            batch = incremental_batch(given, key, watermark)
        else:
            given, batch, known = next(planned)
        result = _cycle(
            spark, given, batch, target_path, key, watermark, len(results) + 1, order_by, with_counts, run, log_path, known
        )
        results.append(result)
        watermark = result.watermark
    return results
