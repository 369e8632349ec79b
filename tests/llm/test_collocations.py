"""Dynamic itemset counting of phrases against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerflow.llm import collocations as c
from ledgerflow.llm.collocations import collocations, phrase_counts, scored, words_of

SCHEMA = "doc_id bigint, text string, lang string, phrase string, size int, `count` bigint, shard int, slot string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, "s") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_counts(rows, longest):
    counts = defaultdict(Counter)
    for text, lang in rows:
        found = counts["und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                found.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts


def brute_collocations(rows, threshold, longest=4, top=2000):
    out = []
    for lang, counts in brute_counts(rows, longest).items():
        n = sum(f for p, f in counts.items() if len(p) == 1)
        found = []
        candidates = {p: f for p, f in counts.items() if len(p) > 1 and f >= threshold}
        for phrase, a in candidates.items():
            cuts = [(2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            inside = any(
                100 * f >= 80 * a and phrase in [q[i : i + len(phrase)] for i in range(len(q) - len(phrase) + 1)]
                for q, f in candidates.items() if len(q) > len(phrase)
            )
            if not inside:
                found.append((score, a, " ".join(phrase), counts[phrase[:k]], counts[phrase[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return out


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "éa", "日本", "x.y", "state", "\x85z", "in\x0bout", "🙂", "a\x00b"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n"]) for _ in range(rng.choice([0, 3, 30, 90])))
        if i % 3 == 0:
            text += " ladies and gentlemen of the jury"
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" \t,;", "fr"), ("one", "it"), ("big apple pie " * 400, "en"), rows[3], rows[3]]


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shards, filter_bits, longest", [(4, 22, 4), (3, 3, 4), (1, 10, 3), (5, 1, 2)])
def test_counts_and_collocations_match_brute_force(spark, shards, filter_bits, longest):
    rows = corpus()
    given = frame(spark, rows)
    found = phrase_counts(given, 6, longest, shards, filter_bits)
    expected = [
        (lang, len(p), " ".join(p), f) for lang, counts in brute_counts(rows, longest).items() for p, f in counts.items() if f >= 6
    ]
    assert listed(found.where("size > 0").select("lang", "size", "phrase", "count")) == sorted(expected)
    got = listed(collocations(given, 6, longest, shards=shards, filter_bits=filter_bits))
    assert got == sorted(brute_collocations(rows, 6, longest)) and got


def test_longer_phrases_start_before_a_cycle_is_over_and_take_a_full_one(spark):
    rows = [("alpha beta gamma delta " * 30, "en")] * 40 + [(f"rare{i % 50} word{i % 50}", "en") for i in range(400)]
    found = phrase_counts(frame(spark, rows), 6, shards=4).where("size > 0")
    steps = {r["phrase"]: (r["start"], r["reach"]) for r in found.collect()}
    assert steps["alpha"] == (0, 0) and steps["alpha beta"] == (1, 1) and steps["alpha beta gamma"] == (2, 2)
    assert steps["alpha beta gamma delta"][0] == 3
    assert max(start for start, _ in steps.values()) > 3  # a rare pair's words got there later
    reach = {p: r for p, (_, r) in steps.items()}
    for p, (start, _) in steps.items():
        words = p.split(" ")
        if len(words) > 1:  # early at most, where another phrase shares the slot
            assert start <= max(reach[" ".join(words[1:])], reach[" ".join(words[:-1])]) + 1
    assert {r["phrase"]: r["count"] for r in found.collect()}["alpha beta gamma delta"] == 40 * 30


def test_shared_slots_leave_no_shard_out(spark):
    """A phrase whose slot another one set early becomes active no sooner than the phrases it holds are known."""
    rng = random.Random(0)
    lines = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 5, 6]))) for _ in range(40)]
    rows = [(" ".join(rng.choice(lines) for _ in range(3)), "en") for _ in range(300)]
    found = phrase_counts(frame(spark, rows), 8, shards=2, filter_bits=6).where("size > 0")
    expected = [(" ".join(p), f) for p, f in brute_counts(rows, 4)["en"].items() if f >= 8]
    assert listed(found.select("phrase", "count")) == sorted(expected)


def test_top_and_ties(spark):
    rows = [("b a. d c. f e. " * 10, "en"), ("b a. d c. " * 10, "de")]
    assert listed(collocations(frame(spark, rows), 5, top=2)) == sorted(brute_collocations(rows, 5, top=2))
    assert [r[2] for r in listed(collocations(frame(spark, rows), 5, top=2)) if r[0] == "en"] == ["b a", "d c"]


def test_empty_tables_and_texts(spark):
    assert collocations(frame(spark, []), 2).count() == 0
    assert collocations(frame(spark, [(None, None), ("", "en"), (" ;. ", "en")]), 2).count() == 0
    assert phrase_counts(frame(spark, []), 2).count() == 0


def test_hot_text_and_very_long_text(spark):
    hot = "same line of words again and again"
    rows = [(hot, "en")] * 300 + [(f"other {i} text of words", "en") for i in range(500)] + [("very long text of words " * 40_000, "de")]
    got = listed(collocations(frame(spark, rows, 7), 20, shards=3))
    assert got == sorted(brute_collocations(rows, 20))


def test_small_chunks_and_blocks_give_the_same_counts(monkeypatch):
    import pyarrow as pa

    rows = [(t or "", lang) for t, lang in corpus(2, 40)]
    texts, languages = pa.array([t for t, _ in rows]), [x or "und" for _, x in rows]
    never = np.zeros(1 << 4, np.uint8)  # all slots may have been reached at step 0

    def counted(chunk, block):
        monkeypatch.setattr(c, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(c, "BLOCK_WORDS", block)
        counter, total = c.ShardCounter(1, 4, 4, never), Counter()
        for part in (slice(0, 7), slice(7, None)):
            batches = [*counter.batch(languages[part], texts[part.start : part.stop])]
            for b in batches:
                total.update({(r["lang"], r["phrase"]): r["count"] for r in b.to_pylist()})
        for b in counter.flush():
            for r in b.to_pylist():
                total[r["lang"], r["phrase"]] += r["count"]
        return total

    expected = Counter()
    for lang, counts in brute_counts([(t, x) for (t, _), x in zip(rows, languages)], 4).items():
        expected.update({(lang, " ".join(p)): f for p, f in counts.items()})
        expected[lang, ""] = sum(f for p, f in counts.items() if len(p) == 1)
    expected = {k: f for k, f in expected.items() if f}
    for chunk, block in [(4 << 20, 1 << 21), (60, 20), (1, 1)]:
        assert counted(chunk, block) == expected
    monkeypatch.setattr(c, "_MULTIPLIER", np.uint64(0))  # all phrases have one hash
    assert counted(4 << 20, 1 << 21) == expected


def test_words_of_texts_that_touch():
    texts = [b"ab Cd", b"", b"ef", b".g", b"h "]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    words, piece, text = words_of(np.frombuffer(b"".join(texts), np.uint8), starts)
    assert words.to_pylist() == [b"ab", b"cd", b"ef", b"g", b"h"]
    assert text.tolist() == [0, 0, 2, 3, 4] and piece[0] == piece[1] and len(set(piece.tolist())) == 4


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 2**62 - 1, 2**62 + 5, 2**62 + 7
    rows = [("x", "en", 0, 0, 0, left, 1), ("y", "en", 0, 0, 0, right, 1), ("x y", "en", 0, 1, 1, a, 2)]
    found = scored(spark.createDataFrame(rows, f"{c.PHRASES}, size int")).collect()
    assert [(r["l"], r["r"], r["score"]) for r in found] == [(left, right, 2_000_000 * a // (left + right))]
    longer = [("en", "x y", 2, a, 1), ("en", "x y z", 3, a * 8 // 10 + 1, 1), ("en", "y z", 2, a - 1, 1)]
    kept = c.without_contained(spark.createDataFrame(longer, "lang string, phrase string, size int, a bigint, score bigint"))
    assert [r["phrase"] for r in kept.select("phrase").collect()] == ["x y z"]
    just_under = [("en", "x y", 2, a, 1), ("en", "x y z", 3, a * 8 // 10, 1)]
    kept = c.without_contained(spark.createDataFrame(just_under, "lang string, phrase string, size int, a bigint, score bigint"))
    assert kept.count() == (1 if 100 * (a * 8 // 10) >= 80 * a else 2)


def test_production_parameters():
    assert (c.THRESHOLD, c.LONGEST, c.TOP, c.CONTAINED_PERCENT) == (30, 4, 2000, 80)
