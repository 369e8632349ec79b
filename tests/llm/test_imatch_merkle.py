"""I-Match fingerprints and the Merkle audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import imatch, merkle
from ledgerflow.llm.imatch import SUBSETS, imatch_report

SCHEMA = "doc_id bigint, text string, print string, copies int, `level` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms_of(text):
    return {xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(r"[^\W_]+", text.lower())}


def brute_lexicon(texts, low, share):
    docs = {}
    for t in texts:
        for c in terms_of(t):
            docs[c] = docs.get(c, 0) + 1
    return {c for c, n in docs.items() if low <= n <= share * len(texts)}


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return h


def brute_print(text, band):
    every = terms_of(text)
    kept = every & band
    if len(kept) < imatch.FEW_TERMS:
        kept = every
    level = max(0, math.ceil(math.log2(max(1, len(kept)) / SUBSETS)))

    def hashes(level):
        out = []
        for s in range(SUBSETS):
            own = sorted(signed(h) for h in kept if h >> 20 & 31 == s and h >> 25 & ((1 << level) - 1) == 0)
            out.append(f"{chained(own) & 0xFFFF:04x}" if own else "")
        return out

    return level, hashes(level), hashes(level + 1)


def brute_likeness(a, b):
    if abs(a[0] - b[0]) > 1:
        return 0.0
    x, y = (a[1], b[1]) if a[0] == b[0] else (a[2], b[1]) if a[0] < b[0] else (a[1], b[2])
    pairs = [(p, q) for p, q in zip(x, y) if p or q]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 1.0


def spell(p):
    return f"{p[0]}:{','.join(p[1])}/{','.join(p[2])}"


def corpus():
    rng = random.Random(5)
    words = [f"t{i}é" for i in range(500)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.choice([0, 2, 10, 60, 300])))) for i in range(50)]
    rows += [(1, rows[4][1]), (2, None), (4, ""), (5, "!!"), (None, "t1é t2é"), (None, "t1é t2é"), (None, None), (6, " ".join(words * 20))]
    return rows + [(9, rows[3][1])]


def ordered(rows):
    def key(row):
        text = row[1] or ""
        spelled = f"{'null' if row[0] is None else row[0]}:{xxhash.xxh64_intdigest(text.encode(), 42):x}"
        return row[0] is None, row[0] or 0, spelled

    return sorted(rows, key=key)


def test_report_matches_brute_force(spark):
    rows = corpus()
    given = ordered(rows)
    texts = [t or "" for _, t in given]
    band = brute_lexicon(texts, imatch.LOW_DOCS, imatch.HIGH_SHARE)
    expected = []
    for n, (i, _) in enumerate(given):
        text, after = texts[n], texts[(n + 1) % len(given)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (brute_print(t, band) for t in (text, edited, after))
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), brute_likeness(a, b), brute_likeness(a, c)))
    got = [tuple(r) for r in imatch_report(table(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_a_rare_term_stays_out_whatever_shares_its_class(spark):
    """Terms are counted by all bits: two rare ones of a class are not one term in two documents."""
    by_class = {}
    rare = []
    for i in range(200_000):  # some 19,000 pairs of a class
        term = f"r{i}"
        other = by_class.setdefault(xxhash.xxh64_intdigest(term.encode(), 42) & ((1 << imatch.CLASS_BITS) - 1), term)
        if other is not term:
            rare.append((other, term))
    rng = random.Random(8)
    common = [f"c{i}" for i in range(400)]
    texts = []
    for i in range(60):
        pairs = rare[i * 20 : i * 20 + 20]
        texts += [" ".join(rng.sample(common, 30) + [p[side] for p in pairs]) for side in (0, 1)]
    # Terms that only a cut makes: "common" ones, in the band, and others.
    texts += ["c1", "c2 c3", "", "c399"] + [" ".join(rng.sample(common, 9)) for _ in range(30)]
    docs = {}
    for t in texts:
        for h in terms_of(t):
            docs[h] = docs.get(h, 0) + 1
    band = {h for h, n in docs.items() if imatch.LOW_DOCS <= n <= imatch.HIGH_SHARE * len(texts)}

    def exact(text):
        kept = terms_of(text) & band
        every = kept if len(kept) >= imatch.FEW_TERMS else terms_of(text)
        level = max(0, math.ceil(math.log2(max(1, len(every)) / SUBSETS)))

        def hashes(level):
            out = []
            for s in range(SUBSETS):
                own = sorted(signed(h) for h in every if h >> 20 & 31 == s and h >> 25 & ((1 << level) - 1) == 0)
                out.append(f"{chained(own) & 0xFFFF:04x}" if own else "")
            return out

        return level, hashes(level), hashes(level + 1)

    expected = []
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        a, b, c = (exact(t) for t in (text, text[: len(text) - cut] + after[:cut], after))
        expected.append((i, spell(a), spell(b), brute_likeness(a, b), brute_likeness(a, c)))
    report = imatch_report(table(spark, list(enumerate(texts))))
    got = report.select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got)) == expected


def test_small_tables_and_native_plan(spark):
    assert imatch_report(table(spark, [])).count() == 0
    (one,) = imatch_report(table(spark, [(7, "abcd efgh")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["near_next"] == 1.0
    plan = imatch_report(table(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_likeness_works_out_each_fingerprint_once(spark):
    df = spark.createDataFrame([(3, [1 << 20, 2 << 20, 3 << 20], [1 << 20, 2 << 20, 4 << 20])], "n int, a array<bigint>, b array<bigint>")
    near = df.select(imatch.likeness(*[imatch.fingerprint(F.col("n"), F.col(side)) for side in "ab"]).alias("near"))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 4  # a fingerprint's two levels
    assert near.first()["near"] == 0.5


PAGES = "page_id bigint, url string, html string, state string, digest int"


def pages(spark, n=400):
    rng = random.Random(6)
    rows = [(i, f"http://h{i % 3}/p{i}", "<p>" + "x" * rng.choice([0, 10, 5000, 70_000 if i % 40 == 0 else 30])) for i in range(n)]
    rows += [(None, None, None), (None, None, None), (3, rows[3][1], rows[3][2]), (900, "", ""), (901, "é", "é")]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES), rows


def record(i, url, html):
    body = html or ""
    name = "" if i is None else f"WARC-Record-ID: <urn:page:{i}>\r\n"
    return f"WARC/1.0\r\nWARC-Type: resource\r\n{name}WARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"


@pytest.mark.parametrize("segment_records", [16, 1024])
def test_audit_locates_all_damage(spark, monkeypatch, segment_records):
    monkeypatch.setattr(merkle, "SEGMENT_RECORDS", segment_records)
    df, rows = pages(spark)
    bad = F.when(F.col("page_id") % 50 == 7, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    got = merkle.fixity_report(df, bad, F.col("page_id") % 50 == 9).collect()
    expected = {}
    for r in rows:
        text = record(*r).encode()
        state = "intact" if r[0] is None else {7: "changed", 9: "lost"}.get(r[0] % 50, "intact")
        copies = expected.get(hashlib.sha256(text).hexdigest(), (0,))[0] + 1
        expected[hashlib.sha256(text).hexdigest()] = (copies, r[0], len(text), state)
    assert {r["record_sha256"]: (r["copies"], r["page_id"], r["length"], r["state"]) for r in got} == expected
    assert len({r["segment"] for r in got}) == (32 if segment_records == 16 else 1)
    for segment in {r["segment"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["segment"] == segment), key=lambda r: r["record_sha256"]):
            assert r["offset"] == at
            at += r["length"]


def test_audit_enters_differing_branches_only(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SEGMENT_RECORDS", 16)
    leaves = spark.range(600).selectExpr("sha2(cast(id AS string), 256) AS digest", "3000 AS length")
    archive = merkle.laid_out(leaves)
    levels = merkle.levels_of(archive)
    ours = merkle.tree(archive, levels)
    one = archive.orderBy("digest").first()["digest"]
    other = merkle.tree(archive.withColumn("digest", F.when(F.col("digest") == one, F.lit("bad")).otherwise(F.col("digest"))), levels)
    assert ours[-1].count() == 1 and ours[0].count() == 600
    entered = []
    keep = merkle.written
    monkeypatch.setattr(merkle, "written", lambda df, name: entered.append((name, df.count())) or keep(df, name))
    found = merkle.audit(ours, other, levels[0])
    assert found.count() == 1 and [n for _, n in entered] == [1] * levels[1]
    assert merkle.audit(ours, ours, levels[0]).count() == 0


def test_files_hold_the_records_at_their_offsets_and_damage_is_found(spark, workdir, monkeypatch):
    import glob
    import shutil

    monkeypatch.setattr(merkle, "SEGMENT_RECORDS", 32)
    df, rows = pages(spark, 200)
    one, two = f"{workdir}/one", f"{workdir}/two"
    index = merkle.write_archive(df, one)
    found = index.collect()
    by_segment = {int(re.search(r"segment=(\d+)", f)[1]): f for f in glob.glob(f"{one}/segment=*/part-*")}
    assert len(by_segment) == len({r["segment"] for r in found}) == 8  # a file each
    for r in found:
        with open(by_segment[r["segment"]], "rb") as file:
            file.seek(r["offset"])
            held = file.read(r["length"])
        assert hashlib.sha256(held).hexdigest() == r["digest"] and held.startswith(b"WARC/1.0") and held.endswith(b"\r\n\r\n")
    assert {r["digest"] for r in found} == {hashlib.sha256(record(*r).encode()).hexdigest() for r in rows}

    assert merkle.audit_files(spark, one, one, index).count() == 0
    first, second, third = sorted({r["segment"] for r in found})[:3]
    # A copy without the third segment, and without the local file system's own checksums, which would stop the read.
    shutil.copytree(one, two, ignore=shutil.ignore_patterns(".*.crc", f"segment={third}"))
    files = {s: glob.glob(f"{two}/segment={s}/part-*")[0] for s in (first, second)}
    hit = [r for r in found if r["segment"] == first][3]
    with open(files[first], "r+b") as file:  # one byte
        file.seek(hit["offset"] + hit["length"] // 2)
        byte = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([byte[0] ^ 1]))
    last = max((r for r in found if r["segment"] == second), key=lambda r: r["offset"])
    with open(files[second], "r+b") as file:  # cut short
        file.truncate(last["offset"] + 5)
    got = {(r["segment"], r["offset"]): r["state"] for r in merkle.audit_files(spark, one, two, index).collect()}
    assert got == {(first, hit["offset"]): "changed", (second, last["offset"]): "lost"} | {
        (third, r["offset"]): "lost" for r in found if r["segment"] == third
    }


def test_empty_archive(spark):
    empty = spark.createDataFrame([], PAGES)
    assert merkle.fixity_report(empty, F.col("html"), F.lit(False)).count() == 0
