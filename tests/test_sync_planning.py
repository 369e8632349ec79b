"""Planned batches, the compacting log, month refreshes and statements with markers."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import (
    batch_edges,
    compact_log,
    insert_if_absent,
    logged_insert,
    month_digests,
    monthly_revenue,
    monthly_revenue_partitioned,
    read_failures,
    read_log,
    read_month_partitioned,
    refresh_month_partitioned,
    run_sync,
    write_month_partitioned,
)
from ledgerflow.operators import sync as sync_module
from ledgerflow.operators import sync_log
from ledgerflow.operators.statements import MarkerMismatch, batch_statement, markers, statement
from ledgerflow.plans import plan_text
from ledgerflow.plans.rental_store import parameter

KV = "k bigint, v bigint"


# Planned batches


def brute_edges(keys, cap, since=None):
    keys, out = sorted(k for k in keys if k is not None and (since is None or k > since)), {}
    for k in sorted(set(keys)):
        before = sum(1 for x in keys if x < k)
        out.setdefault(before // cap, []).append((k, keys.count(k)))
    return [(b, ks[0][0], ks[-1][0], sum(n for _, n in ks)) for b, ks in sorted(out.items())]


@pytest.mark.parametrize("cap, since", [(1, None), (7, 10), (50, None), (1000, -1)])
def test_edges_match_brute_force(spark, cap, since):
    rng = random.Random(cap)
    keys = [rng.randrange(80) for _ in range(150)] + [33] * 60 + [None, None]
    df = spark.createDataFrame([(k, 1) for k in keys], KV).repartition(5)
    got = [tuple(r) for r in batch_edges(df, "k", cap, since).orderBy("batch").collect()]
    assert got == brute_edges(keys, cap, since)
    assert batch_edges(df.where("k > 1000"), "k", cap).count() == 0


def test_text_keys_are_planned(spark, workdir):
    df = spark.createDataFrame([(c, 1) for c in "hgfedcba"], "code string, v int")
    results = run_sync(spark, df, f"{workdir}/codes", "code", cap=3, with_counts=False)
    assert [(r.found, r.watermark) for r in results] == [(3, "c"), (3, "f"), (2, "h"), (0, "h")]


def test_keys_are_scanned_once_a_run(spark, workdir, monkeypatch):
    source = f"{workdir}/src"
    spark.createDataFrame([(k, k) for k in range(100)], KV).repartition(4).write.parquet(source)
    planned = []
    real = sync_module.batch_edges
    monkeypatch.setattr(sync_module, "batch_edges", lambda *a: planned.append(1) or real(*a))
    # A batch is read by its edges: no search for the cap-th key, no pass over its range.
    monkeypatch.setattr(sync_module, "batch_range", lambda *a: pytest.fail("the batch's range is known"))
    results = run_sync(spark, spark.read.schema(KV).parquet(source), f"{workdir}/t", "k", cap=10, with_counts=False)
    assert [r.found for r in results] == [10] * 10 + [0] and len(planned) == 1
    text = plan_text(sync_module.incremental_batch(spark.read.schema(KV).parquet(source), "k", 9, up_to=19))
    assert "GreaterThan(k,9), LessThanOrEqual(k,19)" in text


def test_same_target_whatever_the_cap(spark, workdir):
    rng = random.Random(9)
    source = spark.createDataFrame([(rng.randrange(60), rng.randrange(5)) for _ in range(200)], KV).repartition(3)
    targets = []
    for cap in (None, 1, 13, 500):
        path = f"{workdir}/cap{cap}"
        results = run_sync(spark, source, path, "k", cap=cap, order_by=["v"], with_counts=False)
        assert sum(r.found for r in results) == 200 and results[-1].found == 0
        targets.append(sorted(tuple(r) for r in spark.read.parquet(path).collect()))
    assert all(t == targets[0] for t in targets)


# The log


def test_run_folder_is_what_spark_writes(spark, workdir):
    for i, run in enumerate(["file:/a b/c=d%e", "viewfs://x/y?z#1", "plain", 'q"\'*[]{}^', "é日\\x", "s3a://b/k:1"]):
        log = f"{workdir}/names{i}"
        batch = spark.createDataFrame([(1, 1)], KV)
        logged_insert(spark, batch, f"{workdir}/nt{i}", "k", log, run, 3)
        assert [n for n in os.listdir(log) if n.startswith("run=")] == [sync_log.run_folder(run)]
        assert sync_log.logged_stages(spark, log, run, 3) == {"intent": 0, "result": 0}
        assert read_log(spark, log).first()["run"] == run


def long_log(spark, path, run, cycles):
    """A log of finished cycles 0 to ``cycles`` - 1, written at once."""
    rows = []
    for c in range(cycles):
        for stage in (sync_log.INTENT, sync_log.RESULT):
            rows.append((c, dt.datetime(2022, 1, 1), 1, c, c, 1, c, None, None, None, stage, 0, None, run))
    df = spark.createDataFrame(rows, sync_log.log_schema(T.LongType()))
    df = df.withColumn("block", (F.col("cycle") / sync_log.BLOCK).cast("int"))
    df.repartition("block").write.partitionBy("run", "block").parquet(path)


def test_a_batch_opens_few_files_after_a_thousand(spark, workdir):
    log, target, run = f"{workdir}/long", f"{workdir}/long_t", "stream/checkpoint"
    long_log(spark, log, run, 1000)
    for cycle in range(1000, 1004):
        logged_insert(spark, spark.createDataFrame([(cycle, 1)], KV), target, "k", log, run, cycle)
    blocks = sorted(int(n.removeprefix("block=")) for n in os.listdir(f"{log}/{sync_log.run_folder(run)}"))
    assert blocks == [*range(-20, 0), 20]  # twenty compacted blocks and the open one
    read = sync_log._block_rows(spark, log, run, sync_log.block_of(1003))
    assert len(read.inputFiles()) == 8  # an intent and a result of each cycle of the block
    results = read_log(spark, log)
    assert results.count() == 1004 and results.agg(F.sum("inserted")).first()[0] == 1004
    for block in range(20):
        assert len([f for f in os.listdir(f"{log}/{sync_log.run_folder(run)}/block={-1 - block}") if f.endswith(".parquet")]) == 1
    # Finished cycles are still known, also those of compacted blocks.
    assert logged_insert(spark, spark.createDataFrame([(5, 1)], KV), target, "k", log, run, 5) is None


def test_lost_between_compaction_and_deletion(spark, workdir, monkeypatch):
    log, run = f"{workdir}/lost", "r"
    long_log(spark, log, run, 60)
    sync_log.log_failure(spark, log, run, 7, "ValueError: once", T.LongType())
    sync_log.log_failure(spark, log, run, 7, "ValueError: twice", T.LongType())
    monkeypatch.setattr(sync_log, "delete_path", lambda *a: False)
    assert compact_log(spark, log, run, 1) == [0]
    assert read_log(spark, log).count() == 60 and read_failures(spark, log).count() == 2
    monkeypatch.undo()
    assert compact_log(spark, log, run, 1) == [0] and compact_log(spark, log, run, 1) == []
    assert read_log(spark, log).count() == 60 and read_failures(spark, log).count() == 2
    assert sync_log.logged_stages(spark, log, run, 7) == {"result": 0}


def test_compaction_keeps_an_intent_without_result(spark, workdir):
    log, run, key = f"{workdir}/open", "r", T.LongType()
    for stage in (sync_log.INTENT, sync_log.RESULT):
        sync_log.append_log(spark, log, sync_log.CycleResult(1, dt.datetime(2022, 1, 1), 1, 1, 1, 1, 1, None, None, None, stage, 4, run=run), key)
    sync_log.append_log(spark, log, sync_log.CycleResult(2, dt.datetime(2022, 1, 1), 1, 1, 1, None, 1, None, None, None, sync_log.INTENT, 5, run=run), key)
    compact_log(spark, log, run, 1)
    assert sync_log.logged_stages(spark, log, run, 1) == {"result": 4}
    assert sync_log.logged_stages(spark, log, run, 2) == {"intent": 5}


# Month refreshes

PAYMENT = "payment_id long, amount decimal(7,2), payment_date timestamp_ntz, tags map<string,int>"


def payments(spark, rows):
    return spark.createDataFrame([(i, Decimal(a), d, t) for i, a, d, t in rows], PAYMENT).repartition(3)


def months_on_disk(path):
    return {n: sorted(os.listdir(f"{path}/{n}")) for n in os.listdir(path) if n.startswith("month=")}


def revenue_of(spark, path):
    layout = read_month_partitioned(spark, path, spark.createDataFrame([], PAYMENT).schema)
    return [tuple(r) for r in monthly_revenue_partitioned(layout, amount="amount", payment_id="payment_id").collect()]


def test_only_changed_months_are_written(spark, workdir):
    path = f"{workdir}/layout"
    rows = [(i, "1.10", dt.datetime(2022, 1 + i % 5, 3), {"a": i}) for i in range(40)] + [(99, "4.40", None, None)]
    first = refresh_month_partitioned(payments(spark, rows), path, date_col="payment_date", key_col="payment_id")
    assert first.written == ["2022-01", "2022-02", "2022-03", "2022-04", "2022-05", None] and first.kept == 0
    before = months_on_disk(path)
    # The same rows in another order and number of files: nothing to do.
    same = refresh_month_partitioned(payments(spark, rows[::-1]).coalesce(1), path, date_col="payment_date")
    assert (same.written, same.removed, same.kept) == ([], [], 6) and months_on_disk(path) == before
    # One changed month rewrites one directory; one that has gone is removed; one is new.
    rows[2] = (2, "9.90", dt.datetime(2022, 3, 4), {"a": 2})
    changed = [r for r in rows if r[2] is None or r[2].month != 5] + [(200, "7.00", dt.datetime(2023, 7, 1), None)]
    done = refresh_month_partitioned(payments(spark, changed), path, date_col="payment_date", key_col="payment_id")
    assert (done.written, done.removed, done.kept) == (["2022-03", "2023-07"], ["2022-05"], 4)
    after = months_on_disk(path)
    assert {m for m in before if after.get(m) == before[m]} == {"month=2022-01", "month=2022-02", "month=2022-04", "month=__HIVE_DEFAULT_PARTITION__"}
    whole = f"{workdir}/whole"
    write_month_partitioned(payments(spark, changed), whole, date_col="payment_date", key_col="payment_id")
    assert revenue_of(spark, path) == revenue_of(spark, whole)
    flat = monthly_revenue(payments(spark, changed), date_col="payment_date", amount="amount", payment_id="payment_id")
    assert revenue_of(spark, path) == [tuple(r) for r in flat.collect()]
    gone = refresh_month_partitioned(payments(spark, []), path, date_col="payment_date")
    assert len(gone.removed) == 6 and revenue_of(spark, path) == []


def test_refresh_lost_in_between_does_the_months_again(spark, workdir, monkeypatch):
    from ledgerflow.operators import revenue as revenue_module

    path = f"{workdir}/lost"
    old = [(i, "1.00", dt.datetime(2022, 1 + i % 3, 3), None) for i in range(9)]
    new = [(0, "5.00", dt.datetime(2022, 1, 3), None), *old[1:]]
    refresh_month_partitioned(payments(spark, old), path, date_col="payment_date")
    real = revenue_module._write_months

    def crash(*args):
        real(*args)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(revenue_module, "_write_months", crash)
    with pytest.raises(RuntimeError):
        refresh_month_partitioned(payments(spark, new), path, date_col="payment_date")
    monkeypatch.undo()
    # The source goes back: the month that was written must not pass for the old one.
    done = refresh_month_partitioned(payments(spark, old), path, date_col="payment_date")
    assert done.written == ["2022-01"] and revenue_of(spark, path)[0] == ("2022-01", Decimal("3.00"), 3)


def test_plain_write_drops_digests_and_digests_see_repeats(spark, workdir):
    path = f"{workdir}/plain"
    rows = [(1, "1.00", dt.datetime(2022, 1, 3), {"x": 1})]
    refresh_month_partitioned(payments(spark, rows), path, date_col="payment_date")
    write_month_partitioned(payments(spark, [(2, "2.00", dt.datetime(2022, 1, 3), None)]), path, date_col="payment_date", replace_months_only=True)
    assert refresh_month_partitioned(payments(spark, rows), path, date_col="payment_date").written == ["2022-01"]
    one, three = (month_digests(payments(spark, rows * n), "payment_date").first() for n in (1, 3))
    assert one["mixed"] == three["mixed"] and one["total"] != three["total"]


def test_refresh_filter_reaches_the_scan(spark, workdir):
    from ledgerflow.operators.revenue import _in_months

    payments(spark, [(1, "1.00", dt.datetime(2022, 1, 3), None)]).write.parquet(f"{workdir}/p")
    df = spark.read.parquet(f"{workdir}/p")
    text = plan_text(df.where(_in_months("payment_date", ["2022-02"], df.schema["payment_date"].dataType)))
    assert "GreaterThanOrEqual(payment_date,2022-02-01T00:00" in text and "LessThan(payment_date,2022-03-01T00:00" in text


# Statements

HOSTILE = "x' OR '1'='1"


def test_hostile_values_stay_values(spark):
    spark.createDataFrame([(1, "a"), (2, HOSTILE), (3, None)], "id long, name string").createOrReplaceTempView("people")
    got = statement(spark, "SELECT id FROM people WHERE name = :name", {"name": HOSTILE}).collect()
    assert [r["id"] for r in got] == [2]
    assert statement(spark, "SELECT id FROM people WHERE name = :name", {"name": "1 OR 1=1"}).count() == 0
    assert statement(spark, "SELECT id FROM people WHERE id > :since", {"since": 1}).count() == 2
    with pytest.raises(Exception):
        batch_statement(spark, "people; DROP VIEW people", ["id"], "id", 0, 10).collect()
    assert batch_statement(spark, "people", ["id", "name"], "id", 1, 1).collect()[0]["name"] == HOSTILE


def test_bound_reaches_the_scan(spark, workdir):
    spark.createDataFrame([(k, k) for k in range(50)], KV).write.parquet(f"{workdir}/kv")
    spark.read.schema(KV).parquet(f"{workdir}/kv").createOrReplaceTempView("kv")
    df = batch_statement(spark, "kv", ["k", "v"], "k", 10, 5)
    assert [r["k"] for r in df.collect()] == [11, 12, 13, 14, 15]
    text = plan_text(df)
    assert "GreaterThan(k,10)" in text and "TakeOrderedAndProject" in text


def test_odd_column_names_are_bound(spark):
    spark.createDataFrame([(1, 2)], ["a b", "c`d"]).createOrReplaceTempView("odd")
    row = batch_statement(spark, "odd", ["c`d", "a b"], "a b", 0, 10).collect()[0]
    assert row.asDict() == {"c`d": 2, "a b": 1}


def test_markers_must_match_values(spark):
    assert markers("SELECT ':no', `a:b`, x::int -- :comment\n/* :nor */ FROM t WHERE a > :since AND b = :b") == {"since", "b"}
    for values in ({}, {"since": 1, "sinse": 2}, {"other": 1}):
        with pytest.raises(MarkerMismatch):
            statement(spark, "SELECT :since AS s", values)


def test_command_line_parameters_are_typed():
    assert [parameter(x) for x in ("a=1", "b=1.5", "c=true", "d=x=y", 'e="q"', "f=", "g=null")] == [
        ("a", 1), ("b", 1.5), ("c", True), ("d", "x=y"), ("e", '"q"'), ("f", ""), ("g", "null")
    ]


def test_empty_file_of_a_replay_is_taken_away(spark, workdir):
    target = f"{workdir}/replayed"
    batch = spark.createDataFrame([(k, 1) for k in range(20)], KV)
    insert_if_absent(spark, batch, target, "k")
    files = sorted(os.listdir(target))
    assert insert_if_absent(spark, batch.where("k % 2 = 0"), target, "k").inserted == 0
    assert sorted(f for f in os.listdir(target) if f.endswith(".parquet")) == [f for f in files if f.endswith(".parquet")]
