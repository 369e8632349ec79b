"""Targets bucketed by their key: no exchange of the target, one of the batch, same rows as a plain target."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import KeyedTable, first_per_key, insert_if_absent, run_sync
from ledgerflow.operators import sync as sync_module
from ledgerflow.operators.keyed_table import MOST_BUCKETS, ROWS_PER_BUCKET, buckets_for
from ledgerflow.operators.sync import absent_rows, batch_range, rows_between
from ledgerflow.plans import plan_text

SCHEMA = "k bigint, v bigint, note string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def keyed(spark, path, rows, buckets=8):
    table = KeyedTable.create(spark, path, spark.createDataFrame([], SCHEMA).schema, "k", buckets)
    if rows:
        table.append(frame(spark, rows).repartition(buckets, "k"))
    return table


def rows_in(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def data_files(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def jobs_of(spark, group, run):
    """(jobs, stages that ran) of what ``run`` starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    ran = [i for i in map(tracker.getStageInfo, stages) if i is not None and i.numCompletedTasks]
    return len(jobs), len(ran)


def test_insert_equals_the_plain_target(spark, workdir):
    rng = random.Random(4)
    there = [(k, -1, "old") for k in range(0, 200, 3)]
    batches = [[(rng.randrange(-5, 320), rng.randrange(9), None if rng.random() < 0.2 else "n") for _ in range(250)] for _ in range(3)]
    batches += [[(None, 1, "x")], [], batches[0]]
    plain = f"{workdir}/plain"
    frame(spark, there).write.parquet(plain)
    table = keyed(spark, f"{workdir}/keyed", there)
    for batch in batches:
        a, b = (insert_if_absent(spark, frame(spark, batch), p, "k", order_by=["v"]) for p in (plain, table.path))
        assert a == b
        assert rows_in(spark.read.schema(SCHEMA).parquet(plain)) == rows_in(table.rows())
    assert rows_in(spark.read.schema(SCHEMA).parquet(table.path)) == rows_in(table.rows())  # plain readers see the same


def test_plan_shuffles_only_the_batch(spark, workdir):
    table = keyed(spark, f"{workdir}/plan", [(k, 0, "old") for k in range(100)])
    batch = frame(spark, [(k, 1, "new") for k in range(50, 150)])
    _, low, high = batch_range(batch, "k")
    with table.exchanges_as_bucketed():
        rows = absent_rows(batch, rows_between(table.rows(), "k", low, high), "k", join="merge")
        text = plan_text(rows, "simple")
        assert text.count("Exchange hashpartitioning") == 1 and "partial_min_by" in text
        assert "Bucketed: true" in plan_text(rows, "formatted") or "SelectedBucketsCount: 8 out of 8" in text
        assert "GreaterThanOrEqual(k,50)" in text and text.count("FileScan parquet") == 1
        assert rows.count() == 50
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_jobs_of_an_overlapping_insert(spark, workdir):
    # Plain: the key range, whether the target has any of it, the anti-join's two sides and the write.
    plain = f"{workdir}/jobs_plain"
    frame(spark, [(k, 0, "old") for k in range(100)]).write.parquet(plain)
    batch = spark.createDataFrame([(k, 1, "new") for k in range(50, 150)], SCHEMA)
    batch.write.parquet(f"{workdir}/batch")
    batch = spark.read.schema(SCHEMA).parquet(f"{workdir}/batch")
    calls = []
    real = sync_module.first_per_key
    sync_module.first_per_key = lambda *a, **k: calls.append(1) or real(*a, **k)
    try:
        jobs, _ = jobs_of(spark, "plain", lambda: insert_if_absent(spark, batch, plain, "k"))
        table = keyed(spark, f"{workdir}/jobs_keyed", [(k, 0, "old") for k in range(100)])
        keyed_jobs, _ = jobs_of(spark, "keyed", lambda: insert_if_absent(spark, batch, table.path, "k"))
    finally:
        sync_module.first_per_key = real
    assert keyed_jobs < jobs and len(calls) <= 3


def test_buckets_hold_their_keys_and_a_replay_adds_no_file(spark, workdir):
    table = keyed(spark, f"{workdir}/files", [])
    batch = frame(spark, [(k, 1, "new") for k in range(500)], 5)
    assert insert_if_absent(spark, batch, table.path, "k").inserted == 500
    files = data_files(table.path)
    assert len(files) == 8  # a file per bucket
    assert insert_if_absent(spark, batch, table.path, "k").inserted == 0 and data_files(table.path) == files
    by_file = spark.read.parquet(table.path).select(F.input_file_name().alias("f"), "k")
    bucket = F.pmod(F.hash("k"), F.lit(8))
    assert by_file.select("f", bucket.alias("b")).distinct().count() == 8
    ordered = [r["k"] for r in spark.read.parquet(f"{table.path}/{files[0]}").collect()]
    assert ordered == sorted(ordered)


def test_opened_by_path_and_rewritten(spark, workdir):
    table = keyed(spark, f"{workdir}/it's", [(k, 0, "old") for k in range(60)])
    for low in (50, 90):
        insert_if_absent(spark, frame(spark, [(k, 1, "n") for k in range(low, low + 50)]), table.path, "k")
    table.forget()
    again = KeyedTable.at(spark, table.path)
    assert (again.key, again.buckets, again.schema) == ("k", 8, table.schema)
    assert again.rows().count() == 140 and len(data_files(again.path)) > 8
    assert "Exchange" not in plan_text(again.rows().groupBy("k").count(), "simple")
    small = again.rewritten(f"{workdir}/rewritten")
    assert len(data_files(small.path)) == 8 and rows_in(small.rows()) == rows_in(again.rows())
    wide = again.rewritten(f"{workdir}/wide", 16)
    assert len(data_files(wide.path)) == 16 and rows_in(wide.rows()) == rows_in(again.rows())
    assert KeyedTable.at(spark, f"{workdir}/none") is None
    with pytest.raises(ValueError):
        keyed(spark, table.path, [])


def test_cycles_into_a_keyed_target(spark, workdir):
    table = keyed(spark, f"{workdir}/cycles", [(k, 0, "old") for k in range(10)])
    results = run_sync(spark, frame(spark, [(k, 1, "n") for k in range(35)]), table.path, "k", cap=10, log_path=f"{workdir}/log")
    assert [(r.found, r.inserted) for r in results] == [(10, 10), (10, 10), (5, 5), (0, 0)]
    assert [r[0] for r in rows_in(table.rows().select("k"))] == sorted(range(35), key=lambda k: repr((k,)))


def test_hot_key_leaves_each_task_once(spark, workdir):
    table = keyed(spark, f"{workdir}/hot", [])
    rows = [(7, i, "hot") for i in range(4000)] + [(k, 0, "n") for k in range(100, 2000)]
    batch = frame(spark, rows, 4)
    assert "partial_min_by" in plan_text(first_per_key(batch, "k"))
    assert insert_if_absent(spark, batch, table.path, "k", order_by=["v"]).inserted == 1901
    assert table.rows().where("k = 7").collect()[0]["v"] == 0


def test_number_of_buckets():
    assert [buckets_for(n) for n in (0, 5, ROWS_PER_BUCKET * 9, 1 << 60)] == [8, 8, 16, MOST_BUCKETS]
