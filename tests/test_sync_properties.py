"""Randomised sync runs checked against a brute-force model of the result."""

from __future__ import annotations

import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from ledgerflow.operators import insert_if_absent, run_sync

SCHEMA = T.StructType(
    [
        T.StructField("k", T.LongType(), True),
        T.StructField("ord", T.LongType(), True),
        T.StructField("payload", T.StringType(), True),
    ]
)

rows = st.lists(
    st.tuples(st.integers(-3, 40), st.integers(0, 5), st.sampled_from(["a", "b", "c", None])), min_size=0, max_size=60
)


def expected_target(initial, source):
    """Target keys keep their rows; each new key gets its first source row by (ord, payload)."""
    out = {k: (k, o, p) for k, o, p in initial}
    for k, o, p in sorted(source, key=lambda r: (r[0], r[1], r[2] is None, r[2] or "")):  # NULLs last
        out.setdefault(k, (k, o, p))
    return sorted(out.values(), key=repr)


def target_rows(spark, path):
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).collect()), key=repr)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(source=rows, initial_keys=st.sets(st.integers(-3, 40), max_size=15))
def test_run_sync_matches_model_whatever_the_cap(spark, workdir, source, initial_keys):
    src = spark.createDataFrame(source, SCHEMA).repartition(3)
    initial = [(k, 9, "t") for k in sorted(initial_keys)]
    # The cycles copy keys above the target's highest key; a full insert
    # afterwards covers keys below it. Together: every source key.
    high = max(initial_keys) if initial_keys else None
    above = [r for r in source if high is None or r[0] > high]
    for cap in (None, 1 if len(above) < 12 else 2, 3, 7):
        path = f"{workdir}/{uuid.uuid4().hex}"
        spark.createDataFrame(initial, SCHEMA).coalesce(1).write.parquet(path)
        results = run_sync(spark, src, path, "k", cap=cap, init=None, with_counts=False)
        assert sum(r.found for r in results) == len(above)
        assert target_rows(spark, path) == expected_target(initial, above)
    insert_if_absent(spark, src, path, "k", order_by=["ord", "payload"])
    got = target_rows(spark, path)
    assert got == expected_target(initial, source)
    assert len({r[0] for r in got}) == len(got)
