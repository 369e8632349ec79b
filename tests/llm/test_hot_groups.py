"""A text that a third of the rows share, and a row that another third repeats in full: whole results all the same."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from ledgerflow.llm.exact_dedup import dedup_report, drop_duplicates
from ledgerflow.llm.imatch import imatch_report
from ledgerflow.llm.license_scan import license_report
from ledgerflow.llm.packing import pack
from ledgerflow.llm.queries import tokenizer_file
from ledgerflow.llm.rendezvous import with_shards, with_slots
from ledgerflow.llm.simhash_dedup import drop_near_duplicates, simhash_report

N = 400
HOT = "one text that a third of all rows have, MIT License and all"
REPEATED = "a row that is there again and again under no id"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, HOT) for i in range(N)] + [(None, REPEATED)] * N
    rows += [(N + i, " ".join(hashlib.sha256(f"{i}{j}".encode()).hexdigest()[:6] for j in range(30))) for i in range(N)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).cache()


def test_exact_dedup(docs):
    got = dedup_report(docs).collect()
    assert len(got) == 3 * N and sum(r["kept"] for r in got) == N + 2
    assert Counter((r["keep_id"], r["group_size"]) for r in got if r["group_size"] > 1) == {(0, N): N, (None, N): N}
    assert sorted((r["doc_id"] for r in drop_duplicates(docs).collect()), key=repr) == sorted([0, None, *range(N, 2 * N)], key=repr)


def test_simhash(docs):
    got = simhash_report(docs).collect()
    assert len(got) == 3 * N
    assert Counter(r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < N) == {0: N}
    assert Counter(r["component_id"] for r in got if r["doc_id"] is None) == {None: N}
    assert drop_near_duplicates(docs).count() == N + 2


def test_slots(docs):
    slots = defaultdict(list)
    for r in with_slots(with_shards(docs, [1.0] * 16)).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 3 * N
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_imatch(docs):
    got = imatch_report(docs).collect()
    assert len(got) == 3 * N
    # Rows repeated in full follow each other; the last of them is followed by the first document of all.
    near = Counter(r["near_next"] for r in got if r["doc_id"] is None)
    assert near[1.0] == N - 1 and sum(near.values()) == N
    assert all(r["near_next"] == 1.0 for r in got if r["doc_id"] is not None and r["doc_id"] < N - 1)


def test_packing_and_scan(docs):
    packed = pack(docs, tokenizer_file(), with_ids=False)
    per_text = packed.groupBy("length").count().collect()
    assert sum(r["count"] for r in per_text) == 3 * N
    assert max(r[0] for r in packed.groupBy("sequence_id").agg({"length": "sum"}).select("sum(length)").collect()) <= 1024
    assert license_report(docs).where("labels = 'mit'").count() == N


def test_rows_with_maps_and_nested_columns_travel_along(spark):
    rows = [(1, "a b", {"k": 1}, [{"m": 2}]), (1, "a b", {"k": 2}, None), (2, "ab", None, []), (3, "c", {}, [{}])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>, nested array<map<string,int>>")
    for filtered in (drop_duplicates(docs), drop_near_duplicates(docs)):
        assert filtered.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in drop_duplicates(docs).collect()) == [1, 3]
