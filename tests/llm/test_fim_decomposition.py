"""Fill-in-middle and power-of-two decomposition against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import decomposition, fim
from ledgerflow.llm.decomposition import decompose, numbered, pieces_of, write_buckets
from ledgerflow.llm.fim import PieceTable, fill_in_middle, fim_report, restored, unit_ends
from ledgerflow.llm.queries import tokenizer_file

SCHEMA = "doc_id bigint, text string, n string, form int, output string, restored string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def rows():
    rng = random.Random(3)
    parts = ["alpha", "é日", "🙂", " ", "\n\t", "\x0b", "\x85", "\xa0", "\x1c", "<P", ">", "<S", "<M", "end."]
    out = [(i, "".join(rng.choices(parts, k=rng.choice([1, 2, 5, 40])))) for i in range(300)]
    out += [(1000 + i, "the <P> mark") for i in range(8)] + [(1010, "<S>"), (1011, "a <M>")]
    out += [(2000, None), (2001, ""), (2002, " \n "), (None, "null id here"), (None, "null id here"), (5, "again a b c")]
    return out + [(3000, "long words " * 30_000), (3001, "x" * 200_000), (-7, "negative id of three")]


def brute_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_report_and_texts_match_brute_force(spark):
    expected = [(i, *brute_fim(i, t)) for i, t in rows()]
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    given = frame(spark, rows()).repartition(5)
    got = [tuple(r) for r in fim_report(given).collect()]
    wanted = [(*e[:5], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, rows())]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    back = restored(fill_in_middle(given))
    assert back.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    wanted = [(*e, t or "") for e, (_, t) in zip(expected, rows())]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, wanted))
    assert back.drop("restored").count() == len(rows())


def test_fim_shares_and_empty_table(spark):
    given = frame(spark, [(i, "one two three four") for i in range(400)])
    assert fill_in_middle(given, fim_percent=0).where("form <> 'plain'").count() == 0
    every = fill_in_middle(given, fim_percent=100, spm_percent=0)
    assert every.where("form <> 'psm'").count() == 0
    assert fim_report(frame(spark, [])).count() == fill_in_middle(frame(spark, [])).count() == 0
    strings = spark.createDataFrame([("a", "one two"), (None, None)], "key string, body string")
    assert fim_report(strings, "key", "body").count() == 2


def test_piece_table_cuts_and_joins():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab é🙂", k=rng.randrange(30))).encode()
        places = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        parts = PieceTable(text).cut(tuple(places))
        assert [p.bytes() for p in parts] == [text[: places[0]], text[places[0] : places[1]], text[places[1] :]]
        again = PieceTable.joined([parts[2], parts[0].sentinel(fim.MIDDLE), parts[0], parts[1]])
        whole = text[places[1] :] + b"<M>" + text[: places[1]]
        assert again.bytes() == whole and again.sha256() == hashlib.sha256(whole).hexdigest()
        place = rng.randrange(len(whole) + 1)
        assert [p.bytes() for p in again.cut((place,))] == [whole[:place], whole[place:]]
        assert unit_ends(text).tolist() == [len(text.decode()[: m.end()].encode()) for m in UNIT.finditer(text.decode())]


def test_pieces_are_powers_of_two():
    for n in [*range(1, 300), 2047, 2048, 2049, 4095, 10_000]:
        for longest in (1, 16, 2048):
            pieces = pieces_of(n, longest)
            assert [s for s, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1]]
            assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 and k <= longest for _, k in pieces)
            short = [k for _, k in pieces if k < longest]
            assert len(set(short)) == len(short)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def documents():
    rng = random.Random(2)
    words = ["alpha", "beta,", "gamma\n", "délta", "123", "<|endoftext|>"]
    out = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 60, 300, 900, 3000])))) for i in range(40)]
    return out + [(100, None), (101, ""), (None, "a b"), (None, "a b"), (3, "again"), (102, "x " * 5000)]


def test_decompose_holds_every_id_once(spark, library):
    given = documents()
    wanted = sorted([*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in given)
    found = decompose(frame(spark, given).repartition(4), tokenizer_file()).collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    by_doc = defaultdict(list)
    for r in found:
        assert r["offset"] == 0 and r["length"] == len(r["ids"]) <= 2048 and r["length"] & (r["length"] - 1) == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"], r["sequence_id"] >> 40, r["doc_tokens"]].append(r)
    got = []
    for (doc_id, _, tokens), parts in by_doc.items():
        parts.sort(key=lambda r: (r["start"], r["sequence_id"]))
        ids = [x for r in parts for x in r["ids"]]
        if doc_id is None and len(ids) > tokens:  # the two equal rows, in one task
            assert len(ids) == 2 * tokens
            one = [x for r in parts[::2] for x in r["ids"]]
            got += [one, one]
            continue
        assert len(ids) == tokens and [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]]
        got.append(ids)
    assert sorted(got) == wanted
    plain = decompose(frame(spark, given), tokenizer_file(), with_ids=False)
    assert "ids" not in plain.columns and plain.count() == len(found)
    assert decompose(frame(spark, []), tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        decompose(frame(spark, given), tokenizer_file(), longest=1000)


def test_buckets_and_batches(spark, workdir):
    pieces = decompose(frame(spark, documents() * 3).repartition(4), tokenizer_file(), longest=256)
    rows = numbered(pieces, tokens_per_batch=1024).collect()
    by_length = defaultdict(list)
    for r in rows:
        by_length[r["length"]].append(r)
    for length, bucket in by_length.items():
        assert sorted(r["place"] for r in bucket) == list(range(len(bucket)))
        assert all(r["batch"] == r["place"] * length // 1024 for r in bucket)
    assert len(rows) == pieces.count()
    write_buckets(pieces, f"{workdir}/buckets")
    stored = spark.read.parquet(f"{workdir}/buckets")
    assert stored.where("bucket <> length").count() == 0 and stored.count() == len(rows)


def test_production_parameters():
    assert (decomposition.LONGEST, decomposition.END_ID, fim.SEED, fim.FIM_PERCENT, fim.SPM_PERCENT) == (2048, 1, 42, 50, 80)
