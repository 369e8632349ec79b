"""Exact dedup, rendezvous sharding and SimHash near-dedup against brute force on small tables."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerflow.llm import exact_dedup, simhash_dedup
from ledgerflow.llm.bktree import Forest, lowest_linked
from ledgerflow.llm.exact_dedup import DigestIndex, dedup_report, drop_duplicates, table_report
from ledgerflow.llm.rendezvous import with_shards, with_slots
from ledgerflow.llm.simhash_dedup import components, drop_near_duplicates, simhash, simhash_report

SCHEMA = "doc_id bigint, text string, keep_id string, shard int, `_llm_key` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def awkward(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, ties, repeated rows and ids, near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 120])))
        rows.append((i, text))
        if i % 4 == 0:
            rows.append((1000 + i, text.replace(" ", "\t\n")))
        if i % 5 == 0:
            parts = text.split()
            parts[len(parts) // 2] = "changed"
            rows.append((2000 + i, " ".join(parts)))
    rows += [(5, rows[0][1]), (70, None), (71, ""), (72, " \t\r\n\x0b\x0c"), (None, "a b c"), (None, "a b c"), (None, None)]
    rows += [(73, "É é x"), (73, "É é x"), (74, "Ab cD"), (75, "aB Cd"), (76, " ".join(words * 400))]
    return rows


def strip(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(strip(t).encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for digest, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0, digest))
    return sorted(out, key=repr)


def test_exact_report_matches_brute_force(spark):
    rows = awkward()
    got = sorted((tuple(r) for r in dedup_report(table(spark, rows)).collect()), key=repr)
    assert got == brute_exact(rows)


def test_exact_empty_table(spark):
    assert dedup_report(table(spark, [])).count() == 0
    assert drop_duplicates(table(spark, [])).columns == table(spark, []).columns


def test_exact_filter_keeps_one_row_of_each_text_with_all_columns(spark):
    rows = awkward()
    kept = drop_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert got == sorted((r[0] for r in brute_exact(rows) if r[3]), key=repr)


def test_exact_second_batch_that_largely_repeats_the_first(spark, workdir):
    """The anti-join meets an index with rows: brute force over two batches, the second four fifths known."""
    rng = random.Random(11)
    spaced = lambda text: text.replace(" ", rng.choice(["", "  ", "\t", " \n"]))
    texts = [" ".join(rng.choices("abcdefghij", k=12)) + f" {i}" for i in range(3000)]
    first = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, spaced(texts[i])) for i in range(0, 3000, 3)]
    known = [(20_000 + i, spaced(t)) for i, t in enumerate(texts) if i % 5]
    new = [(30_000 + i, f"new {i % 400}" + " " * (i % 3)) for i in range(600)] + [(None, "new 7"), (None, None), (None, None)]
    second = known + new + [(40_000 + i, texts[1]) for i in range(1500)] + new[:50]
    index = DigestIndex.open(spark, f"{workdir}/index", 16)
    kept_by = {}
    for batch, rows in (("b1", first), ("b2", second)):
        rng.shuffle(rows)
        groups = defaultdict(list)
        for i, t in rows:
            groups["".join((t or "").split())].append((-len(t or ""), i is None, i or 0))
        expected = []
        for plain, members in groups.items():
            own = plain not in kept_by
            best = min(members)
            keep = kept_by.setdefault(plain, None if best[1] else best[2])
            digest = hashlib.sha256(plain.encode()).hexdigest()
            for n, member in enumerate(sorted(members)):
                expected.append((None if member[1] else member[2], keep, len(members), own and n == 0, digest))
        got = dedup_report(table(spark, rows), index, batch).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
        assert index.rows().count() == len(kept_by)
        assert got.where("kept").count() == sum(r[3] for r in expected) == (3000 if batch == "b1" else 401)
    assert {r["batch"]: r["count"] for r in index.rows().groupBy("batch").count().collect()} == {"b1": 3000, "b2": 401}


def test_exact_index_persists_and_replays(spark, workdir):
    first = [(1, "a b"), (2, "ab "), (3, "c")]
    second = [(4, "a  b"), (5, "d"), (6, "d")]
    index = DigestIndex.open(spark, f"{workdir}/index", 4)
    one = {r["doc_id"]: r["keep_id"] for r in dedup_report(table(spark, first), index, "b1").collect()}
    assert one == {1: 1, 2: 1, 3: 3}
    again = DigestIndex.open(spark, f"{workdir}/index", 4)
    for _ in range(2):  # a replay of the batch gives the same answer and adds nothing
        two = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in dedup_report(table(spark, second), again, "b2").collect()}
        assert two == {4: (1, False), 5: (5, True), 6: (5, False)}
        assert again.rows().count() == 3
    files = {f for f in os.listdir(f"{workdir}/index") if f.endswith(".parquet")}
    assert len(files) <= 2 * 4 + 2  # a file per bucket and batch; the replays found nothing new
    plan = again.rows().select("digest").hint("merge").join(again.rows().select("digest"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()  # co-located by bucket


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_table_report_matches_brute_force(spark, batches):
    rows = awkward() + [(500 + i, "b  a " + " " * (i % 7)) for i in range(60)]
    assert sorted((tuple(r) for r in table_report(table(spark, rows), batches).collect()), key=repr) == brute_exact(rows)
    assert table_report(table(spark, []), batches).count() == 0


def test_exact_batches_meet_the_index(spark, monkeypatch):
    """Copies in later batches meet rows of the index; only a better one is appended."""
    rows = [(i, f"text {i % 50}" + " " * (i % 4)) for i in range(600)]
    fed = []
    real = exact_dedup._feed

    def seen(groups, index, batch):
        before = index.rows().count()
        real(groups, index, batch)
        fed.append((groups.count(), before, index.rows().count() - before))

    monkeypatch.setattr(exact_dedup, "_feed", seen)
    got = sorted((tuple(r) for r in table_report(table(spark, rows)).collect()), key=repr)
    assert got == brute_exact(rows)
    assert len(fed) == exact_dedup.BATCHES and fed[0][1] == 0 and fed[0][2] == fed[0][0]
    assert all(before >= 50 and added < given for given, before, added in fed[2:])


def brute_shard(doc_id, shards):
    key = "n" if doc_id is None else f"k{doc_id}"
    scores = [(int(hashlib.sha256(f"{key}#{s}".encode()).hexdigest()[:13], 16), -s) for s in range(shards)]
    return -max(scores)[1]


def test_shards_match_brute_force_and_move_only_into_the_new_one(spark):
    rows = awkward()
    got = with_slots(with_shards(table(spark, rows), [1.0] * 16)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_shard(i, 16), brute_shard(i, 17))
        for i, t in rows
        if i is not None
    )
    assert {r["shard"] for r in got if r["doc_id"] is None} == {brute_shard(None, 16)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert with_slots(with_shards(table(spark, []), [1.0] * 4)).count() == 0


def test_weighted_shares(spark):
    ids = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    counts = {r["shard"]: r["count"] for r in with_shards(ids, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 20000 - 0.5) < 0.02 and abs(counts[0] / 20000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        with_shards(ids, [1.0, 0.0])


def brute_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(codes, radius=3):
    """codes: {item: code}; the smallest item reachable, for every item."""
    parent = {i: i for i in codes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = list(codes)
    for n, a in enumerate(items):
        for b in items[:n]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in items}


def test_simhash_report_matches_brute_force(spark):
    rows = awkward()
    got = simhash_report(table(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(r["doc_id"], r["fingerprint"]) for r in got}
    assert prints == {(i, f"{brute_simhash(t):016x}") for i, t in rows}
    codes = {n: brute_simhash(t) for n, (i, t) in enumerate(rows)}
    groups = defaultdict(list)
    for n, root in brute_components(codes).items():
        groups[root].append(n)
    expected = []
    for members in groups.values():
        ids = [rows[n][0] for n in members if rows[n][0] is not None]
        expected += [(rows[n][0], min(ids) if ids else None) for n in members]
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted(expected, key=repr)
    kept = [r["doc_id"] for r in drop_near_duplicates(table(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted((min((rows[n][0] for n in m if rows[n][0] is not None), default=None) for m in groups.values()), key=repr)
    assert simhash_report(table(spark, [])).count() == 0


@pytest.mark.parametrize("tree_nodes", [3, 4096])
def test_components_of_dense_codes_with_cut_shards(spark, monkeypatch, tree_nodes):
    """Codes close together (one shard holds nearly all) give the same components when shards are cut."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    codes = {}
    for i in range(150):
        code = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 5, 9])):
            code ^= 1 << rng.randrange(64)
        codes[i] = code
    docs = spark.createDataFrame([(i, str(c)) for i, c in codes.items()], "doc_id bigint, text string")
    signed = {str(c): c - (1 << 64) if c >> 63 else c for c in codes.values()}
    monkeypatch.setattr(simhash_dedup, "simhash", lambda text, shingle: signed[text])

    def fake(df, shingle, id_col, text_col):
        from ledgerflow.llm.common import row_key, written

        rows = [(i, signed[str(c)]) for i, c in codes.items()]
        fps = spark.createDataFrame(rows, "doc_id bigint, fp bigint").join(df, "doc_id")
        return written(fps.select("doc_id", row_key("doc_id", "text").alias("row_key"), "fp"), "fake")

    monkeypatch.setattr(simhash_dedup, "fingerprints", fake)
    rows, classes = components(docs, tree_nodes=tree_nodes)
    got = {r["doc_id"]: r["component_id"] for r in rows.join(classes, "fp").collect()}
    assert got == brute_components(codes)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    codes = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base[:5] ^ np.uint64(56)]))
    trees = np.sort(rng.integers(0, 3, len(codes)))
    for radius in (0, 1, 3, 40):
        forest = Forest(codes, trees)
        found = {(int(q), int(n)) for block in forest.within(codes, trees, radius) for q, n in zip(*block)}
        expected = {
            (a, b)
            for a in range(len(codes))
            for b in range(len(codes))
            if trees[a] == trees[b] and (int(codes[a]) ^ int(codes[b])).bit_count() <= radius
        }
        assert found == expected
    assert list(lowest_linked(5, [(np.array([3, 4]), np.array([4, 1]))])) == [0, 1, 2, 1, 1]


def test_simhash_values():
    assert simhash(None) == simhash("") == simhash(" \n") == 0
    h = xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash("One\tTWO") & ((1 << 64) - 1) == h
    assert struct.pack("<q", simhash("x")) == struct.pack("<Q", xxhash.xxh64_intdigest(b"x", 42))
