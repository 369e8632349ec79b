"""The pipeline on a small corpus, stage by stage against brute force; the registered queries and their SQL."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF001, SF01
from ledgerflow.llm import resampling, toxicity
from ledgerflow.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

from __spark_entry__ import oracle_sql, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, fp bigint"


def corpus(spark, workdir):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.choice([3, 5, 7]))) for _ in range(300)]
    texts, labels = [], []
    for i in range(240):
        body = rng.choices(words, k=rng.choice([30, 80, 150]))
        bad, toxic = i % 8 == 0, i % 8 == 3
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["nasty", "awful"]))
        texts.append((i, " ".join(w + ("%%%" if bad else "") for w in body)))
        labels.append((i, int(not bad), int(toxic)))
    clean = [t for t, (_, q, x) in zip(texts, labels) if q and not x]
    texts += [(1000 + i, t.replace(" ", "\n")) for i, t in clean[:20]]  # copies
    texts += [(2000 + i, t + " end") for i, t in clean[20:40]]  # near copies, mostly
    texts += [(3000, None), (3001, ""), (None, clean[50][1]), (7, texts[7][1])]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, True, 1) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{workdir}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (9999, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{workdir}/labels.parquet")


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_stages_against_brute_force(spark, workdir):
    corpus(spark, workdir)
    docs = spark.read.parquet(f"{workdir}/documents.parquet")
    labels = spark.read.parquet(f"{workdir}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, workdir)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            path = f"{workdir}/{name}.parquet"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            seen[name] = (seen[name][0], docs)
    assert list(seen) == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]

    before, after = seen["quality"]
    report = resampling.quality_report(before, resampling.fit(before, labels)).collect()
    assert sorted((r["doc_id"] for r in report if r["kept"]), key=repr) == [i for i, _ in rows_of(after)]
    assert not [t for _, t in rows_of(after) if t and "%%%" in t]

    before, after = seen["toxicity"]
    report = toxicity.toxicity_report(before, toxicity.fit(before, labels)).collect()
    assert sorted((r["doc_id"] for r in report if not r["predicted"]), key=repr) == [i for i, _ in rows_of(after)]
    assert not [t for _, t in rows_of(after) if t and "nasty" in t and "awful" in t]

    before, after = seen["exact_dedup"]
    groups = defaultdict(list)
    for i, t in rows_of(before):
        groups["".join((t or "").split())].append((-len(t or ""), i is None, i or 0, i, t))
    assert rows_of(after) == sorted([min(g, key=lambda x: x[:3])[3:] for g in groups.values()], key=repr)

    before, after = seen["near_dedup"]
    given = rows_of(before)
    codes = [brute_simhash(t) for _, t in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(given)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    members = defaultdict(list)
    for n, row in enumerate(given):
        members[find(n)].append((row[0] is None, row[0] or 0, row))
    assert rows_of(after) == sorted([min(m, key=lambda x: x[:2])[2] for m in members.values()], key=repr)

    before, after = seen["packing"]
    library = Tokenizer.from_file(tokenizer_file())
    wanted = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows_of(before))
    pieces = defaultdict(list)
    for r in after.collect():
        pieces[r["doc_id"]].append((r["piece"], r["ids"]))
    assert sorted([x for _, ids in sorted(p) for x in ids] for p in pieces.values()) == wanted


def test_run_gives_the_last_stage(spark, workdir):
    corpus(spark, workdir)
    packed = corpus_pipeline.run(spark, workdir)
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(packed.columns) and packed.count() > 0
    assert max(r[0] for r in packed.groupBy("sequence_id").agg({"length": "sum"}).select("sum(length)").collect()) <= 1024


def test_empty_tables_pass_through(spark, workdir):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{workdir}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{workdir}/labels.parquet")
    assert corpus_pipeline.run(spark, workdir).count() == 0


def test_all_operators_are_registered():
    known = queries()
    assert set(QUERIES) | {"pipeline"} <= set(known)
    for n in range(1, 14):
        assert len([name for name in known if name.startswith(f"op{n}_")]) == 1
    assert set(ORACLE_SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("folder", [SF001, SF01])
def test_sql_gives_the_same_rows(spark, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = con.sql(ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    chosen = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, con.sql(f"SELECT {chosen} FROM ({ORACLE_SQL[name]})").fetchall())) and got
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(expected.columns, expected.types)}


def test_every_row_has_its_result(spark):
    for name, table, key in [("op1_toxicity", "documents", "doc_id"), ("op3_license_scan", "documents", "doc_id"),
                             ("op4_resampling", "documents", "doc_id"), ("op6_bpe", "documents", "doc_id"),
                             ("op7_rendezvous", "documents", "doc_id"), ("op9_imatch", "documents", "doc_id"),
                             ("op10_simhash", "documents", "doc_id")]:
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF001}/{table}.parquet").select(key).collect())
        assert sorted(r[0] for r in QUERIES[name](spark, SF001).select(key).collect()) == ids, name
