"""The stream in operation: restarts after failures, stops between batches, keys kept in a state store."""

from __future__ import annotations

import glob
import json
import os
import signal
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import ROOT
from ledgerflow.operators import KeyedTable, read_failures, read_log
from ledgerflow.streaming import StopGate, run_supervised, start_sync
from ledgerflow.streaming import sync_stream as stream_module
from ledgerflow.streaming.supervisor import StopRequested, _short

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])


def land(spark, path, keys, value=1):
    spark.createDataFrame([(k, value) for k in keys], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def keys_in(spark, path):
    return sorted(r["k"] for r in spark.read.schema(SCHEMA).parquet(path).select("k").collect())


class Sync:
    """Starts of one stream, with what is in its way."""

    def __init__(self, spark, workdir, **options):
        self.spark, self.options = spark, options
        self.landing, self.target = f"{workdir}/landing", f"{workdir}/target"
        self.log, self.checkpoint = f"{workdir}/log", f"{workdir}/checkpoint"

    def start(self, gate):
        options = {"available_now": True, "max_files_per_trigger": 1, **self.options}
        return start_sync(
            self.spark, self.landing, SCHEMA, self.target, "k", self.checkpoint, self.log, gate=gate, **options
        )

    def run(self, gate=None, **options):
        log = (self.log, self.checkpoint, T.LongType())
        return run_supervised(self.spark, self.start, gate, log, **{"first_delay": 0.05, **options})

    def committed(self):
        return sorted(int(f) for f in os.listdir(f"{self.checkpoint}/commits") if f.isdigit())


class Failing(StopGate):
    """Turns the given numbers of attempts away, by batch."""

    def __init__(self, times):
        super().__init__()
        self.times = dict(times)

    def enter(self, batch_id):
        super().enter(batch_id)
        if self.times.get(batch_id):
            self.times[batch_id] -= 1
            raise ConnectionError(f"source is away in batch {batch_id}")


@pytest.mark.parametrize("keyed_state", [False, True])
def test_a_source_that_fails_twice(spark, workdir, keyed_state):
    sync = Sync(spark, workdir, keyed_state=keyed_state)
    for part in range(4):
        land(spark, sync.landing, range(part * 10, part * 10 + 12))  # two keys of each part recur in the next
    outcome = sync.run(Failing({1: 2, 3: 1}))
    assert (outcome.starts, outcome.failures, outcome.stopped) == (4, 3, False)
    assert outcome.delays == [0.05, 0.1, 0.05]  # doubled in a row; from the start again after a batch that committed
    assert keys_in(spark, sync.target) == list(range(42))
    failures = [(r["cycle"], r["error"]) for r in read_failures(spark, sync.log).orderBy("logged_at").collect()]
    assert failures == [(b, f"ConnectionError: source is away in batch {b}") for b in (1, 1, 3)]
    results = read_log(spark, sync.log).orderBy("cycle").collect()
    assert [(r["cycle"], r["inserted"]) for r in results] == [(0, 12), (1, 10), (2, 10), (3, 10)]


def test_a_source_that_is_not_there_and_giving_up(spark, workdir):
    sync = Sync(spark, workdir)
    with pytest.raises(Exception, match="(?i)path does not exist|PATH_NOT_FOUND"):
        sync.run(max_failures=2)
    assert [r["cycle"] for r in read_failures(spark, sync.log).collect()] == [0, 0]
    land(spark, sync.landing, range(5))
    assert sync.run().failures == 0 and keys_in(spark, sync.target) == list(range(5))


def test_delays_are_bounded(spark, workdir):
    sync = Sync(spark, workdir)
    land(spark, sync.landing, range(5))
    outcome = sync.run(Failing({0: 4}), first_delay=0.01, longest_delay=0.03)
    assert outcome.delays == [0.01, 0.02, 0.03, 0.03]


def test_stop_lets_the_running_batch_commit(spark, workdir, monkeypatch):
    sync = Sync(spark, workdir, available_now=False, interval="0 seconds")
    for part in range(5):
        land(spark, sync.landing, range(part * 10, part * 10 + 10))
    gate, began = StopGate(), threading.Event()
    real = stream_module.logged_insert

    def slow(*args, **kwargs):
        if args[6] == 1:
            began.set()
            time.sleep(1.5)  # the stop comes while batch 1 is being worked on
        return real(*args, **kwargs)

    monkeypatch.setattr(stream_module, "logged_insert", slow)
    threading.Thread(target=lambda: (began.wait(60), gate.request())).start()
    outcome = sync.run(gate)
    assert outcome.stopped and outcome.failures == 0
    assert sync.committed() == [0, 1]
    assert sorted(r["cycle"] for r in read_log(spark, sync.log).collect()) == [0, 1]
    assert keys_in(spark, sync.target) == list(range(20))
    sync.options["available_now"] = True
    assert sync.run(StopGate()).failures == 0
    assert keys_in(spark, sync.target) == list(range(50))
    assert read_failures(spark, sync.log).count() == 0


def test_stop_between_batches_and_gate(spark, workdir):
    sync = Sync(spark, workdir, available_now=False, interval="0 seconds")
    land(spark, sync.landing, range(5))
    gate = StopGate()

    def stop_when_idle():
        for _ in range(300):
            if os.path.exists(f"{sync.checkpoint}/commits/0"):
                break
            time.sleep(0.1)
        gate.request()

    threading.Thread(target=stop_when_idle).start()
    assert sync.run(gate).stopped and sync.committed() == [0]
    with pytest.raises(StopRequested):
        gate.enter(3)
    assert sync.run(gate).starts == 0  # a stop that came before


def test_a_signalled_process_leaves_a_committed_batch_and_its_row(spark, workdir):
    sync = Sync(spark, workdir)
    for part in range(3):
        land(spark, sync.landing, range(part * 10, part * 10 + 10))
    land(spark, sync.target, [1000])
    code = (
        "from ledgerflow.session import build_session; "
        f"build_session('local[2]', shuffle_partitions=2, conf={{'spark.ui.enabled': 'false', 'spark.checkpoint.dir': {workdir + '/shared'!r}, "
        f"'spark.sql.warehouse.dir': {workdir + '/warehouse'!r}}}); "
        "from ledgerflow.streaming.__main__ import main; main()"
    )
    options = ["--source", sync.landing, "--target", sync.target, "--key", "k", "--checkpoint", sync.checkpoint,
               "--log", sync.log, "--interval", "0 seconds", "--max-files-per-trigger", "1"]
    process = subprocess.Popen([sys.executable, "-c", code, *options], cwd=ROOT, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
                               env={**os.environ, "PYTHONPATH": ROOT}, text=True)
    for _ in range(900):
        if glob.glob(f"{sync.checkpoint}/commits/[0-9]*") or process.poll() is not None:
            break
        time.sleep(0.1)
    process.send_signal(signal.SIGTERM)
    out, _ = process.communicate(timeout=120)
    assert process.returncode == 0 and "stopped after 1 starts, 0 failures" in out
    done = sync.committed()
    assert done and done == sorted(r["cycle"] for r in read_log(spark, sync.log).collect())
    assert keys_in(spark, sync.target) == [*range(10 * len(done)), 1000]


def test_keyed_state_brings_each_key_once_and_keeps_the_target(spark, workdir):
    sync = Sync(spark, workdir, keyed_state=True)
    land(spark, sync.target, range(0, 20, 2), value=-1)
    for part in range(3):
        land(spark, sync.landing, [*range(part * 10, part * 10 + 15), 3, 3])
    sync.run()
    rows = spark.read.schema(SCHEMA).parquet(sync.target)
    assert keys_in(spark, sync.target) == list(range(35))
    assert rows.where("v = -1").count() == 10
    logged = [(r["cycle"], r["inserted"]) for r in read_log(spark, sync.log).orderBy("cycle").collect()]
    assert logged == [(0, 7), (1, 8), (2, 10)]  # 16 and 18 of the second part are the target's
    land(spark, sync.landing, [3, 5, 100])  # a restart with more
    sync.run()
    assert keys_in(spark, sync.target) == [*range(35), 100]


def test_keyed_state_looks_at_the_target_once_a_start(spark, workdir, monkeypatch):
    sync = Sync(spark, workdir, keyed_state=True)
    for part in range(4):
        land(spark, sync.landing, range(part * 10, part * 10 + 10))
    compared = []
    real_append, real_insert = stream_module.append_new_keys, stream_module.logged_insert

    def seen(batch, target_path, key, batch_id, *args, **kwargs):
        compared.append(kwargs["compare"])
        return real_append(batch, target_path, key, batch_id, *args, **kwargs)

    monkeypatch.setattr(stream_module, "append_new_keys", seen)
    inserts = []
    monkeypatch.setattr(stream_module, "logged_insert", lambda *a, **k: inserts.append(a[6]) or real_insert(*a, **k))
    monkeypatch.setattr(stream_module, "insert_if_absent", lambda *a, **k: pytest.fail("the target is read"))
    sync.run()
    assert compared == [True, False, False, False] and inserts == [0] and keys_in(spark, sync.target) == list(range(40))


def test_keyed_state_replay_of_a_batch_that_landed(spark, workdir, monkeypatch):
    sync = Sync(spark, workdir, keyed_state=True)
    for part in range(3):
        land(spark, sync.landing, range(part * 10, part * 10 + 10))
    real = stream_module.append_log

    def lost(session, path, entry, key_type):
        if entry.cycle == 1 and entry.stage == "result":
            raise RuntimeError("driver lost")
        return real(session, path, entry, key_type)

    monkeypatch.setattr(stream_module, "append_log", lost)
    with pytest.raises(Exception, match="driver lost"):
        sync.run(max_failures=1)
    assert keys_in(spark, sync.target) == list(range(20))  # batch 1 landed, and was not committed
    monkeypatch.setattr(stream_module, "append_log", real)
    sync.run()
    assert keys_in(spark, sync.target) == list(range(30))
    logged = [(r["cycle"], r["found"], r["inserted"]) for r in read_log(spark, sync.log).orderBy("cycle").collect()]
    assert logged == [(0, 10, 10), (1, 10, 10), (2, 10, 10)]


def test_keyed_state_is_a_rocksdb_store_and_feeds_keyed_tables(spark, workdir):
    sync = Sync(spark, workdir, keyed_state=True)
    table = KeyedTable.create(spark, sync.target, SCHEMA, "k", 4)
    for part in range(2):
        land(spark, sync.landing, range(part * 10, part * 10 + 15))
    sync.run()
    assert keys_in(spark, sync.target) == list(range(25)) and table.rows().count() == 25
    assert glob.glob(f"{sync.checkpoint}/state/0/*/*.changelog") + glob.glob(f"{sync.checkpoint}/state/0/*/*.zip")
    with open(f"{sync.checkpoint}/offsets/0") as lines:
        conf = next(json.loads(x)["conf"] for x in lines if x.startswith("{") and "conf" in json.loads(x))
    assert "RocksDB" in conf["spark.sql.streaming.stateStore.providerClass"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != conf["spark.sql.streaming.stateStore.providerClass"]


def test_stop_keeps_a_hot_key_once(spark, workdir):
    sync = Sync(spark, workdir, keyed_state=True)
    spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v")).write.parquet(sync.landing)
    sync.run()
    assert len(keys_in(spark, sync.target)) == len(set(keys_in(spark, sync.target))) == 2000 + 1 - 1


def test_error_texts():
    text = "[FOREACH_BATCH] An error\nTraceback (most recent call last):\n  File x\nConnectionError: source is away\n\nmore"
    assert _short(text) == "ConnectionError: source is away"
    assert _short("java.io.IOException: disk\n\tat x") == "java.io.IOException: disk" and _short("") == "str"
    assert _short("first line\nsecond") == "first line"
