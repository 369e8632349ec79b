"""Importance resampling and the toxicity network: brute force on small tables, gradients, held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import gru, resampling, toxicity
from ledgerflow.llm.resampling import BUCKETS, features, fit, quality_report, resampled

SCHEMA = "doc_id bigint, text string, score double, label int, weight string"
LABELS = "doc_id bigint, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "w") for i, t in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def brute_features(text):
    tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    one = [signed(h) % BUCKETS for h in hashes]
    return one + [0 if a == b else signed((a << 1) % 2**64 ^ b) % BUCKETS for a, b in zip(hashes, hashes[1:])]


def test_features_match_brute_force(spark):
    texts = ["Hello, hello World!! 12_x", "", None, "a a a", "é É ß", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(features(F.coalesce("text", F.lit("")))).collect()]
    assert got == [brute_features(t) for t in texts]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    good = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = rng.choices(good, k=rng.choice([5, 30, 80]))
        rows.append((i, " ".join(w + ("$$$" if bad else "") for w in words)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "word1 word2"), (None, "word1 word2"), (7, rows[7][1]), (1002, "word3 " * 30_000)]
    return rows, labels + [(None, 1, 0), (1, None, None), (5000, 1, 1)]


def test_resampling_matches_brute_force_and_parts_good_from_bad(spark):
    rows, labels = corpus()
    docs = table(spark, rows)
    model = fit(docs, labels_of(spark, labels))
    got = quality_report(docs, model).collect()
    assert len(got) == len(rows)
    # Models and weights.
    target = {i for i, q, _ in labels if q == 1 and i is not None and zlib.crc32(str(i).encode()) % 5}
    key = lambda i: xxhash.xxh64_intdigest(str(i).encode(), 42)
    first = {i for i in target if xxhash.xxh64_intdigest(struct.pack("<Q", key(i)), 42) % 2 == 0}
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(brute_features(t))
        if i in first:
            good.update(brute_features(t))
    share = sum(good.values()) / sum(raw.values())
    ratio = [math.log((good[b] + resampling.SMOOTHING) / (raw[b] * share + resampling.SMOOTHING)) for b in range(BUCKETS)]
    weight = {(i, t): sum(ratio[b] for b in brute_features(t)) for i, t in rows}
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (i, t), w in weight.items():
        if i is not None:
            assert by_id[i]["log_weight"] == pytest.approx(w, abs=1e-3 * (1 + len((t or "").split())))
    # The k largest perturbed values stay, k being the number of weights at or over the cut.
    steps = sorted((math.floor(r["perturbed"] * resampling.STEPS) for r in got), reverse=True)
    assert all(r["kept"] == (math.floor(r["perturbed"] * resampling.STEPS) >= model.threshold) for r in got)
    assert model.threshold in steps
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & {i for i, t in rows if t and "$" in t and len(t.split()) > 5}
    clean = {i for i, t in rows if i is not None and i < 300 and "$" not in t}
    assert len(clean - kept) <= 0.1 * len(clean)  # the draw: short texts weigh about as much either way
    stays = resampled(docs, model)
    assert stays.columns == docs.columns and stays.count() == sum(r["kept"] for r in got)


@pytest.mark.parametrize("role", [resampling.COUNTED, resampling.GOOD, resampling.BAD])
def test_an_id_of_many_rows_is_one_labelled_row(spark, monkeypatch, role):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" $$$" * 20 if i % 5 == 0 else "")) for i in range(300)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(300)]
    used = resampling._labelled_ids(labels_of(spark, labels), "doc_id", "quality", 1000).collect()
    hot = min(r["label_id"] for r in used if r["role"] == role)
    rows[hot] = (hot, " ".join(rng.choices(words, k=40)) + " extra" * 10)
    seen = []
    keep = resampling._cut
    monkeypatch.setattr(resampling, "_cut", lambda good, bad: seen.append((len(good), len(bad))) or keep(good, bad))
    # Repeats with smaller texts: the largest one is used either way.
    docs = table(spark, rows + [(hot, None)] * 10 + [(hot, " ".join(["!", *words[:5]]))] * 150)
    model = fit(docs, labels_of(spark, labels))
    n = Counter(r["role"] for r in used)
    assert seen == [(n[resampling.GOOD], n[resampling.BAD])]
    raw, good = Counter(), Counter()
    for r in docs.select("text").collect():
        raw.update(brute_features(r["text"]))
    for i, t in rows:
        if i in {r["label_id"] for r in used if r["role"] == resampling.COUNTED}:
            good.update(brute_features(t))
    share = sum(good.values()) / sum(raw.values())
    s = resampling.SMOOTHING
    assert model.log_ratio == tuple(round(math.log((good[b] + s) / (raw[b] * share + s)) * resampling.UNITS) for b in range(BUCKETS))


def test_resampling_without_labels_or_rows(spark):
    rows, labels = corpus(20)
    docs = table(spark, rows)
    assert resampled(docs, fit(docs, labels_of(spark, []))).count() == len(rows)
    empty = table(spark, [])
    assert quality_report(empty, fit(empty, labels_of(spark, labels))).count() == 0


def test_kth_largest_is_exact(spark):
    rng = random.Random(2)
    values = [rng.randrange(-(10**7), 10**7) for _ in range(500)] + [5] * 50 + [-3] * 20
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    for k in (1, 2, 100, 300, len(values)):
        assert resampling._kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in gru.initial(3, 4, 1).items()}
    x, mask = rng.normal(size=(5, 6, 3)), np.ones((5, 6))
    mask[3:, 0] = 0
    mask[:, 1] = 0
    y, weight = np.array([1.0, 0, 1, 0, 1, 1]), np.ones(6)
    _, grad = gru.loss_and_gradient(params, x, mask, y, weight)
    for name, value in params.items():
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(4)]:
            before = value[at]
            losses = []
            for step in (1e-3, -1e-3):
                value[at] = before + step
                losses.append(gru.loss_and_gradient(params, x, mask, y, weight)[0])
            value[at] = before
            assert grad[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-3)


def brute_score(model, text):
    """Each window of a text by itself, step by step."""
    p, words = model.params, toxicity.words_of(text)
    best = -np.inf
    for start in toxicity.window_starts(len(words)):
        part = words[start : start + toxicity.WINDOW]
        x = [toxicity.word_inputs([w], model.known)[0] for w in part]
        states = {}
        for side, order in (("f", x), ("b", x[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            if side == "b":  # padding comes first when read backwards
                order = [None] * (toxicity.WINDOW - len(part)) + order
            for step in order:
                w = p[f"c{side}"] if step is None else step @ p[f"W{side}"] + p[f"c{side}"]
                u, n = h @ p[f"U{side}"], toxicity.HIDDEN
                z, r = 1 / (1 + np.exp(-(w + u)[:n])), 1 / (1 + np.exp(-(w + u)[n : 2 * n]))
                new = np.tanh(w[2 * n :] + r * u[2 * n :])
                h = (1 - z) * new + z * h
                out.append(h)
            states[side] = out if side == "f" else out[::-1][: len(part)]
        joined = [np.concatenate(s) for s in zip(states["f"], states["b"])]
        weight = np.array([math.exp(j @ p["attend"]) for j in joined])
        pooled = sum(w * j for w, j in zip(weight / weight.sum(), joined)) if joined else np.zeros(2 * toxicity.HIDDEN)
        best = max(best, float(pooled @ p["out"] + p["bias"][0]))
    return 1 / (1 + math.exp(-max(-30, min(30, best - model.shift))))


def toxic_corpus(n=500, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.choice([3, 5, 7]))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.choice([4, 40, 200]))
        toxic = i % 4 == 0
        if toxic:  # a known word, or a new ending of a known stem
            for _ in range(rng.choice([1, 3])):
                body.insert(rng.randrange(len(body) + 1), rng.choice(["nasty", "vequ" + "".join(rng.choices("xyz", k=2))]))
        texts.append(" ".join(body))
        labels.append(int(toxic))
    return texts, labels


def test_network_learns_and_scores_every_window():
    texts, labels = toxic_corpus()
    model = toxicity.train(texts[:300], labels[:300])
    score = model.scorer()
    scores = score(texts[300:])
    held = np.array(labels[300:])
    assert ((scores >= 0.5) == held).mean() > 0.95
    clean = " ".join(t for t, y in zip(texts, labels) if not y)  # a long text
    assert score([clean])[0] < 0.5 <= score([clean + " nasty nasty vequzz " + clean])[0]
    some = [None, "", "!!", "one", texts[0], texts[1], texts[301], "w " * 37]
    assert score(some) == pytest.approx([brute_score(model, t) for t in some], abs=1e-4)
    assert score(some[::-1])[::-1] == pytest.approx(score(some), abs=1e-5)


def test_word_cache_overflow(monkeypatch):
    texts, labels = toxic_corpus(80)
    model = toxicity.train(texts, labels)
    expected = model.scorer()(texts)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 10)
    small = model.scorer()
    assert np.concatenate([small(texts[i : i + 3]) for i in range(0, 80, 3)]) == pytest.approx(expected, abs=1e-5)


def test_toxicity_report(spark):
    texts, labels = toxic_corpus(200)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, texts[0]), (None, texts[0]), (3, texts[3])]
    docs = table(spark, rows)
    given = [(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (4, None, None)]
    model = toxicity.fit(docs, labels_of(spark, given))
    got = toxicity.toxicity_report(docs, model).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] < 200]
    assert np.mean([a == b for a, b in held]) > 0.9
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r["predicted"] for r in got)
    assert toxicity.toxicity_report(table(spark, []), model).count() == 0
    nothing = toxicity.fit(docs, labels_of(spark, [(1, 1, 0)]))
    assert {r["score"] for r in toxicity.toxicity_report(docs, nothing).collect()} == {0.0}


def test_parting_by_weight():
    value, y = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 1, 0, 1])
    assert toxicity._parting(value, y, np.array([1.0, 1.0, 5.0, 1.0])) == 2.5  # missing the toxic one costs less
    assert toxicity._parting(value, y, np.array([1.0, 5.0, 1.0, 1.0])) == 0.5


def test_long_labelled_texts_take_part_in_the_cut(spark, monkeypatch):
    texts, labels = toxic_corpus(240)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 2000)
    monkeypatch.setattr(toxicity, "LONG_ROWS", 20)
    monkeypatch.setattr(toxicity, "OTHER_ROWS", 30)
    clean = " ".join(t for t, y in zip(texts, labels) if not y)[:9000]
    rows = list(enumerate(texts)) + [(1000 + i, clean + (" nasty vequxx nasty" if i % 2 else "")) for i in range(60)]
    given = [(i, 1, y) for i, y in enumerate(labels)] + [(1000 + i, 1, i % 2) for i in range(60)]
    docs = table(spark, rows)
    found = toxicity.sample(docs, labels_of(spark, given), "toxic", "doc_id", "text")
    free = [(y, i >= 1000) for i, _, y in given if zlib.crc32(str(i).encode()) % 5]
    most = {(1, False): toxicity.TOXIC_ROWS, (0, False): 30, (1, True): 20, (0, True): 20}
    assert found.stands_for == {k: free.count(k) / min(free.count(k), most[k]) for k in most}
    chosen = [(r["label"], r["long"]) for r in found.chosen.collect()]
    assert {k: chosen.count(k) for k in most} == {k: min(free.count(k), most[k]) for k in most}
    model = toxicity.fit(docs, labels_of(spark, given))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_report(docs, model).collect()}
    assert [got[1000 + i] for i in range(60)] == [i % 2 for i in range(60)]
    # Without any label on long rows the cut is that of the short ones.
    short = toxicity.fit(docs, labels_of(spark, [g for g in given if g[0] < 1000]))
    assert np.isfinite(short.shift)
