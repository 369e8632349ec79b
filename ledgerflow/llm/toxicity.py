"""Toxicity of whole texts by a bidirectional gated recurrent network (``gru.py``).

A text is read in windows of ``WINDOW`` words, each starting half a window
after the one before; all windows of the whole text are scored and the
text's score is that of its highest one. Each word enters as numbers from
two tables: what is known of the whole word and what is known of the runs of
``GRAMS`` bytes in it (word ends marked), so that new forms of a known stem
are met too. What is known is how much more often it occurs in toxic than in
other training texts, and in how many.

Training takes a bounded sample of the labelled rows: ``TOXIC_ROWS`` and
``OTHER_ROWS`` at most, those with the smallest hashes of their ids, of texts
up to ``TRAIN_CHARS`` characters; rows with crc32(id as text) mod 5 = 0
never. One half fills the tables, the other trains the network; then the
halves change places and the tables of both are joined for use. A toxic text
is labelled as a whole, so the windows to learn from are chosen in turns: the
highest ones of toxic texts, the highest and some others of the rest.
At the end scores are shifted so that 0.5 parts the training texts and up to
``LONG_ROWS`` labelled longer ones of each label best, which are scored whole
by the tasks; each weighs as many labelled rows as it stands for.

The id, language and source are never inputs. Null text counts as empty; a
text without words has one empty window. Rows with null labels or unknown
ids are not learnt from. If either label is missing, every score is 0. Rows
repeated have equal scores. An empty table gives an empty answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import gru
from ledgerflow.llm.common import prepare, text_of, written
from ledgerflow.llm.resampling import held_out

WINDOW = 24
STRIDE = 12
HIDDEN = 8
GRAMS = (4, 5, 6)
TABLE_BITS = 18
INPUTS = 6
TOXIC_ROWS = 2000
OTHER_ROWS = 4000
TRAIN_CHARS = 12_000
# Labelled rows of each label with longer texts that take part in finding the shift.
LONG_ROWS = 300
TURNS = 4
BATCH = 256
# Added to the counts of both labels, in their proportion.
PRIOR = 4.0
# Words whose inputs a worker keeps, and windows it scores at once.
CACHED_WORDS = 250_000
WINDOWS_AT_ONCE = 4096
TEXTS_AT_ONCE = 128

_SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters, in UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SEPARATORS).split()


def _cells(hashes: np.ndarray) -> np.ndarray:
    """Places in a table of 2^TABLE_BITS."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table cells of the words, cells of all their byte runs, and where each word's runs begin (at least one each)."""
    buffer = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(buffer))  # bytes from here to the word's end
    rolling = np.zeros(len(buffer), np.uint64)
    padded = np.concatenate([buffer, np.zeros(max(GRAMS), np.uint64)])
    runs, of_word = [], []
    number = np.repeat(np.arange(len(words)), sizes)
    for k in range(max(GRAMS)):
        rolling = rolling * _FACTOR + padded[k : k + len(buffer)] + np.uint64(1)
        if k + 1 in GRAMS:
            fits = left >= k + 1
            if k + 1 == min(GRAMS):  # a shorter word is a run by itself
                fits = fits | ((left == np.repeat(sizes, sizes)) & (left < k + 1))
            runs.append(rolling[fits])
            of_word.append(number[fits])
    runs_all, of_all = np.concatenate(runs), np.concatenate(of_word)
    order = np.argsort(of_all, kind="stable")
    first = np.searchsorted(of_all[order], np.arange(len(words)))
    # The whole word: the sum of its runs of the least size (mixed), which its bytes determine.
    mixed = runs_all[order]
    whole = np.add.reduceat(mixed * (mixed >> np.uint64(7)), first)
    return _cells(whole), _cells(mixed), first


class Tables:
    """What is known of words and byte runs: log odds and evidence by hashed cell."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, 2, 1 << TABLE_BITS), np.float32)  # (word or run, label, cell): texts
        self.texts = np.zeros(2, np.float32)

    def add(self, words: list[bytes], label: int) -> None:
        self.texts[label] += 1
        if words:
            whole, runs, _ = _hashed(list(set(words)))
            self.counts[0, label, np.unique(whole)] += 1
            self.counts[1, label, np.unique(runs)] += 1

    def joined(self, other: Tables) -> Tables:
        both = Tables()
        both.counts, both.texts = self.counts + other.counts, self.texts + other.texts
        return both

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, evidence), each (word or run, cell)."""
        share = self.texts / max(1.0, self.texts.sum())
        rates = [(self.counts[:, i] + PRIOR * share[i]) / max(1.0, self.texts[i]) for i in (0, 1)]
        odds = np.log(np.maximum(rates[1], 1e-9)) - np.log(np.maximum(rates[0], 1e-9))
        return np.clip(odds, -3, 6).astype(np.float32), np.log1p(self.counts.sum(axis=1)).astype(np.float32)


def word_inputs(words: list[bytes], known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(words, INPUTS): of the word its odds and evidence; of its runs the highest odds and that run's evidence, and their mean; 1."""
    odds, evidence = known
    whole, runs, first = _hashed(words)
    out = np.ones((len(words), INPUTS), np.float32)
    out[:, 0], out[:, 1] = odds[0, whole], evidence[0, whole]
    run_odds, run_evidence = odds[1, runs], evidence[1, runs]
    out[:, 2] = np.maximum.reduceat(run_odds, first)
    count = np.diff(np.append(first, len(runs)))
    highest = run_odds >= np.repeat(out[:, 2], count)
    out[:, 3] = np.maximum.reduceat(np.where(highest, run_evidence, 0), first)
    out[:, 4] = np.add.reduceat(run_odds, first) / count
    return out * np.array([0.5, 0.3, 0.5, 0.3, 0.5, 1.0], np.float32)


def window_starts(n_words: int) -> np.ndarray:
    """Starts of the overlapping windows that cover a text; one (empty) window for a text without words."""
    return np.arange(0, max(1, n_words - STRIDE), STRIDE) if n_words > STRIDE else np.zeros(1, np.int64)


def windows_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, text): for texts laid end to end in ``ids`` the ids of every window (0 past a text's end), and its text."""
    begins = np.concatenate([[0], ends[:-1]])
    starts = [window_starts(int(n)) for n in ends - begins]
    text = np.repeat(np.arange(len(ends)), [len(s) for s in starts])
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW) + begins[text][:, None]
    inside = at < ends[text][:, None]
    padded = np.append(ids, 0)
    return np.where(inside, padded[np.where(inside, at, len(ids))], 0), text


class Model:
    """Tables and trained network; scores texts."""

    def __init__(self, known, params: gru.Params | None, shift: float = 0.0) -> None:
        self.known, self.params, self.shift = known, params, shift

    def scorer(self, raw: bool = False):
        """A function from texts to scores, which keeps the projected inputs of the words it met lately."""
        if self.params is None:
            return lambda texts: np.full(len(texts), -np.inf if raw else 0.0)
        p = self.params
        width = p["cf"].shape[0]
        # Row 0 stands for places past a text's end: no input.
        kept = np.zeros((CACHED_WORDS + 1, 2 * width), np.float32)
        kept[0, :width], kept[0, width:] = p["cf"], p["cb"]
        number: dict[bytes, int] = {}

        def project(words: list[bytes], start: int) -> None:
            x = word_inputs(words, self.known)
            kept[start : start + len(words), :width] = x @ p["Wf"] + p["cf"]
            kept[start : start + len(words), width:] = x @ p["Wb"] + p["cb"]

        def score(texts) -> np.ndarray:
            nonlocal kept
            lists = [words_of(t) for t in texts]
            new = {w for ws in lists for w in ws if w not in number}
            if len(number) + len(new) > CACHED_WORDS:
                number.clear()
                new = {w for ws in lists for w in ws}
                if len(new) + 1 > len(kept):  # one text may hold more words than are kept
                    kept = np.concatenate([kept[:1], np.zeros((len(new), 2 * width), np.float32)])
            if new:
                words, start = list(new), len(number) + 1
                number.update(zip(words, range(start, start + len(words))))
                for i in range(0, len(words), 50_000):
                    project(words[i : i + 50_000], start + i)
            total = sum(map(len, lists))
            ids = np.fromiter((i for ws in lists for i in map(number.__getitem__, ws)), np.int64, total)
            ends = np.cumsum([len(ws) for ws in lists])
            best = np.full(len(lists), -np.inf)
            places, text = windows_of(ids, ends)
            for i in range(0, len(text), WINDOWS_AT_ONCE):
                at = np.ascontiguousarray(places[i : i + WINDOWS_AT_ONCE].T)
                found = gru.logits(
                    p,
                    lambda t: kept[at[t], :width],
                    lambda t: kept[at[WINDOW - 1 - t], width:],
                    (at > 0).astype(np.float32),
                )
                np.maximum.at(best, text[i : i + WINDOWS_AT_ONCE], found)
            return best if raw else 1 / (1 + np.exp(-np.clip(best - self.shift, -30, 30)))

        return score


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """The model of a bounded sample of whole texts."""
    return _trained(texts, labels, seed)[0]


def _trained(texts: list[str], labels: list[int], seed: int = 0) -> tuple[Model, np.ndarray]:
    """The model, and the logit of each text's highest window as the other half's counts give it."""
    y = np.asarray(labels, np.int64)
    tables = (Tables(), Tables())
    if not (0 < y.sum() < len(y)):
        return Model(tables[0].known(), None), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    half = np.zeros(len(y), np.int64)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        half[own[::2]] = 1
    for i, text in enumerate(texts):
        tables[half[i]].add(words_of(text), int(y[i]))
    # The words' inputs, texts end to end after a row for no word; a text's come from the other half's counts.
    known = [t.known() for t in tables]
    inputs, sizes = [np.zeros((1, INPUTS), np.float32)], []
    for i, text in enumerate(texts):
        words = words_of(text)
        sizes.append(len(words))
        if words:
            inputs.append(word_inputs(words, known[1 - half[i]]))
    inputs = np.concatenate(inputs)
    places, text_of_window = windows_of(np.arange(1, len(inputs), dtype=np.int32), np.cumsum(sizes))
    said = inputs[:, 0] * inputs[:, 1] + inputs[:, 2] * inputs[:, 3]
    height = said[places].max(axis=1)  # of a window: first what its words' tables say, then its logit
    params = gru.initial(INPUTS, HIDDEN, seed)
    adam = gru.Adam(params)

    def highest() -> np.ndarray:
        order = np.lexsort((-height, text_of_window))
        first = np.r_[True, np.diff(text_of_window[order]) > 0]
        return order[first]

    def measure() -> np.ndarray:
        out = []
        for i in range(0, len(places), WINDOWS_AT_ONCE):
            at = places[i : i + WINDOWS_AT_ONCE].T
            out.append(
                gru.logits(
                    params,
                    lambda t: inputs[at[t]] @ params["Wf"] + params["cf"],
                    lambda t: inputs[at[WINDOW - 1 - t]] @ params["Wb"] + params["cb"],
                    (at > 0).astype(np.float32),
                )
            )
        return np.concatenate(out)

    window_label = y[text_of_window]
    for turn in range(TURNS):
        others = rng.permutation(np.flatnonzero(window_label == 0))[: len(y)]
        chosen = np.unique(np.concatenate([highest(), others]))
        toxic = window_label[chosen] == 1
        # Between leaving the labels' shares as they are and making them equal.
        heavier = np.float32(((~toxic).sum() / max(1, toxic.sum())) ** 0.5)
        adam.rate = 0.02 / (1 + turn)
        for _ in range(max(1, -(-60 * BATCH // len(chosen)))):  # small samples are gone over more often
            order = rng.permutation(chosen)
            for i in range(0, len(order), BATCH):
                at = places[order[i : i + BATCH]].T
                target = window_label[order[i : i + BATCH]].astype(np.float32)
                weight = np.where(target == 1, heavier, np.float32(1))
                _, grad = gru.loss_and_gradient(params, inputs[at], (at > 0).astype(np.float32), target, weight)
                adam.update(grad)
        height = measure()
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, text_of_window, height)
    return Model(tables[0].joined(tables[1]).known(), params, _parting(best, y, np.ones(len(y)))), best


def _parting(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which least weight falls on the wrong side."""
    order = np.argsort(value)
    v, label, w = value[order], y[order], weight[order]
    missed, alarms = np.cumsum(w * label), np.cumsum((w * (1 - label))[::-1])[::-1]
    wrong = np.concatenate([[0], missed]) + np.concatenate([alarms, [0]])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9 * w.sum())
    cut = least[len(least) // 2]
    low, high = v[max(0, cut - 1)], v[min(len(v) - 1, cut)]
    return float((low + high) / 2)


@dataclass(frozen=True)
class Sample:
    """Ids to learn from: (label_id, label, long), written; how many rows with a label each chosen one stands for."""

    chosen: DataFrame
    stands_for: dict[tuple[int, bool], float]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> Sample:
    """A bounded number of labelled ids, by label and by whether their shortest text is over ``TRAIN_CHARS``."""
    identity = F.col(f"`{id_col}`")
    known = (
        labels.where(identity.isNotNull() & F.col(f"`{label_col}`").isin(0, 1) & ~held_out(identity))
        .groupBy(identity.alias("label_id"))
        .agg(F.max(f"`{label_col}`").alias("label"))
    )
    sizes = docs.where(identity.isNotNull()).groupBy(identity.alias("doc_id")).agg(F.min(F.length(text_of(text_col))).alias("chars"))
    eligible = known.join(sizes, known["label_id"] == sizes["doc_id"]).select("label_id", "label", (F.col("chars") > TRAIN_CHARS).alias("long"))
    eligible = written(eligible, "eligible")
    found = {(r["label"], r["long"]): r["count"] for r in eligible.groupBy("label", "long").count().collect()}
    hashed = F.xxhash64(F.col("label_id").cast("string"))
    most = {(1, False): TOXIC_ROWS, (0, False): OTHER_ROWS, (1, True): LONG_ROWS, (0, True): LONG_ROWS}
    chosen = None
    for (label, is_long), rows in most.items():
        part = eligible.where((F.col("label") == label) & (F.col("long") == is_long)).orderBy(hashed, "label_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    return Sample(written(chosen, "labelled"), {k: n / min(n, most[k]) for k, n in found.items()})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the short texts of the sample; the shift parts these and the long ones, which are scored whole where they lie.

    Texts of up to ``TRAIN_CHARS`` characters reach the driver, of long ones their highest logits only. Each
    text weighs as many labelled rows as it stands for, so the shift means the same at every size.
    """
    found = sample(docs, labels, label_col, id_col, text_col)
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def rows_of(is_long: bool) -> DataFrame:
        # Broadcast: TOXIC_ROWS + OTHER_ROWS ids at most, or 2 * LONG_ROWS.
        ids = F.broadcast(found.chosen.where(F.col("long") == is_long).select("label_id", "label"))
        return given.where((F.length("text") > TRAIN_CHARS) == is_long).join(ids, F.col("doc_id") == F.col("label_id"))

    short = rows_of(False).groupBy("doc_id", "label").agg(F.max("text").alias("text")).toPandas().sort_values("doc_id")
    model, best = _trained(short["text"].tolist(), short["label"].astype(int).tolist())
    if model.params is None:
        return model
    tall = rows_of(True).select("doc_id", "label", _scored(docs.sparkSession, model, F.col("text"), raw=True).alias("height"))
    tall = tall.groupBy("doc_id", "label").agg(F.max("height").alias("height")).toPandas().sort_values("doc_id")
    y = np.concatenate([short["label"], tall["label"]]).astype(np.int64)
    is_long = np.arange(len(y)) >= len(short)
    weight = np.array([found.stands_for[int(label), bool(flag)] for label, flag in zip(y, is_long)])
    return Model(model.known, model.params, _parting(np.concatenate([best, tall["height"]]).astype(float), y, weight))


def _scored(spark: SparkSession, model: Model, text: Column, raw: bool = False) -> Column:
    """The score of a text, or the logit of its highest window; the model (a few MB, whatever the input) is broadcast."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer(raw)
        for texts in batches:
            parts = [scorer(texts.iloc[i : i + TEXTS_AT_ONCE].tolist()) for i in range(0, len(texts), TEXTS_AT_ONCE)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    return _scored(docs.sparkSession, model, text_of(text_col))


def toxicity_report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), score_column(docs, model, text_col).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    return docs.where(score_column(docs, model, text_col) < 0.5)
