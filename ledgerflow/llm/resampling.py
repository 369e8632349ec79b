"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text are its words and runs of other visible characters, in
lower case, and each two that follow each other, hashed into ``BUCKETS``
buckets; two equal ones in a row are one feature, whatever they are. The raw
model counts the features of all documents. Of the rows labelled good and of
those labelled bad, ``LABELLED_ROWS`` each at most (those with the smallest
hashes of their ids; held-out rows never) are used: one half of the good ones
is counted for the target model, the rest finds the cut. An id that several
rows have is used once, with the largest of its texts. A bucket's log ratio compares its target count with
the count that the raw model expects there, ``SMOOTHING`` added to either, so
that a bucket with few of both says little. The log weight of a document is
the sum of the log ratios of its features.

Adding Gumbel noise to log weights and taking the k largest draws k documents
without replacement by their weights. The noise comes from a hash of the
row's id and text, so a run can be repeated. k is the number of documents
whose log weight reaches the cut, the value that parts the uncounted good rows
from the bad ones with the fewest on the wrong side: as many as pass for
target text. The k-th largest value is found by
counting, so no rows are sorted or gathered; rows equal to it all stay.

Null text counts as empty: log weight 0. Rows repeated in full have equal
values and stay or go together. Null labels and labels of unknown ids are
not used; without any good label nothing tells target from raw and every
row stays; without any bad one the lowest good row is the cut. An empty table gives an empty answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import row_key, text_of, unused, written

BUCKETS = 10_000
LABELLED_ROWS = 20_000
SMOOTHING = 20.0
# Rows with crc32(id as text) mod HELD_OUT = 0 are never learnt from.
HELD_OUT = 5
SEED = 1
# Log ratios are whole numbers of 1 / UNITS, so that their sums do not depend on an order.
UNITS = 1_000_000
# Perturbed weights are compared in steps of 1 / STEPS.
STEPS = 1024
TOKENS = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+"


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """array<int> of the buckets of all features of a text, repeats included."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))

    def of_hashes(hashes: Column) -> Column:
        def pair(following: Column, i: Column) -> Column:
            here = F.get(hashes, i)
            both = F.pmod(F.shiftleft(here, 1).bitwiseXOR(following), F.lit(buckets)).cast("int")
            return F.when(here == following, F.lit(0)).otherwise(both)

        one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
        two = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), pair)
        return F.concat(one, two)

    # A one-element array binds the hashes to a name: tokens are cut and hashed once.
    return F.get(F.transform(F.array(F.transform(tokens, lambda t: F.xxhash64(t))), of_hashes), 0)


@dataclass(frozen=True)
class Resampler:
    """Log ratios of the buckets (in ``UNITS``) and the cut found on the documents they were counted on."""

    log_ratio: tuple[int, ...]
    threshold: int | None
    id_col: str = "doc_id"
    text_col: str = "text"

    def log_weight(self) -> Column:
        if not self.log_ratio:
            return F.lit(0.0)
        table = F.split(F.lit(",".join(map(str, self.log_ratio))), ",").cast("array<bigint>")
        found = features(text_of(self.text_col), len(self.log_ratio))
        total = F.aggregate(found, F.lit(0).cast("bigint"), lambda total, bucket: total + F.get(table, bucket))
        return total / F.lit(float(UNITS))

    def noise(self) -> Column:
        key = F.concat(row_key(self.id_col, self.text_col), F.lit(f"#{SEED}"))
        bits = F.shiftrightunsigned(F.xxhash64(key), 12)
        return -F.log(-F.log((bits.cast("double") + 0.5) * F.lit(2.0**-52)))

    def kept(self, perturbed: Column) -> Column:
        return F.lit(True) if self.threshold is None else steps(perturbed) >= F.lit(self.threshold)


def steps(value: Column) -> Column:
    return F.floor(value * STEPS).cast("bigint")


COUNTED, GOOD, BAD = 1, 2, 3


def _labelled_ids(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(label_id, role) of the rows to use: good ones that are counted, good ones and bad ones that find the cut."""
    identity = F.col(f"`{id_col}`")
    known = (
        labels.where(identity.isNotNull() & F.col(f"`{label_col}`").isin(0, 1) & ~held_out(identity))
        .groupBy(identity.alias("label_id"))
        .agg(F.min(f"`{label_col}`").alias("label"))
    )
    key = F.xxhash64(F.col("label_id").cast("string"))
    role = F.when(F.col("label") == 0, F.lit(BAD)).when(F.xxhash64(key) % 2 == 0, F.lit(COUNTED)).otherwise(F.lit(GOOD))
    good, bad = (known.where(F.col("label") == v).orderBy(key, "label_id").limit(most) for v in (1, 0))
    return good.unionByName(bad).select("label_id", role.alias("role"))


def _cut(good: list[float], bad: list[float]) -> float:
    """The middle of the lowest gap at which fewest are on the wrong side."""
    marked = sorted([(w, 1) for w in good] + [(w, 0) for w in bad])
    wrong, best = len(bad), (len(bad) + 1, 0)
    for i, (weight, is_good) in enumerate(marked):  # wrong: if the cut is just under marked[i]
        if (not i or weight > marked[i - 1][0]) and wrong < best[0]:
            best = (wrong, i)
        wrong += 1 if is_good else -1
    i = best[1]
    return (marked[i - 1][0] + marked[i][0]) / 2 if i else marked[0][0]


def _kth_largest(values: DataFrame, k: int) -> int:
    """The k-th largest of the longs in column ``value``, by counting 16 bits at a time from the top."""
    known, shift = 0, 48
    shifted = values.select((F.col("value") + F.lit(1 << 62)).alias("value"))
    while True:
        inside = shifted if shift == 48 else shifted.where(F.shiftrightunsigned("value", shift + 16) == F.lit(known))
        part = F.shiftrightunsigned("value", shift).bitwiseAND(F.lit(0xFFFF)).alias("part")
        for row in inside.groupBy(part).count().orderBy(F.desc("part")).collect():  # 65,536 rows at most
            if row["count"] >= k:
                known = (known << 16) | row["part"]
                break
            k -= row["count"]
        if shift == 0:
            return known - (1 << 62)
        shift -= 16


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    labelled_rows: int = LABELLED_ROWS,
) -> Resampler:
    """Count both models over ``docs`` and find the cut; a row per bucket and per label id used reach the driver."""
    # Broadcast: twice labelled_rows ids at most.
    known = F.broadcast(written(_labelled_ids(labels, id_col, label_col, labelled_rows), "labelled-ids"))
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    # One text an id, however many rows have the id: the largest.
    found = given.join(known, given["doc_id"] == known["label_id"]).groupBy("label_id", "role").agg(F.max("text").alias("text"))
    labelled = written(found, "labelled-texts")

    def counted(rows: DataFrame) -> list[int]:
        counts = [0] * BUCKETS
        for row in rows.select(F.explode(features(F.col("text"))).alias("bucket")).groupBy("bucket").count().collect():
            counts[row["bucket"]] = row["count"]
        return counts

    raw, good = counted(given), counted(labelled.where(F.col("role") == COUNTED))
    if not sum(good):
        return Resampler((), None, id_col, text_col)
    share = sum(good) / sum(raw)
    ratios = tuple(round(math.log((g + SMOOTHING) / (r * share + SMOOTHING)) * UNITS) for g, r in zip(good, raw))
    model = Resampler(ratios, None, "doc_id", "text")
    weights = written(given.select(model.log_weight().alias("weight"), model.noise().alias("noise")), "weights")
    shown = labelled.where(F.col("role").isin(GOOD, BAD)).select("role", model.log_weight().alias("weight")).collect()
    good_weights, bad_weights = ([r["weight"] for r in shown if r["role"] == v] for v in (GOOD, BAD))
    if not good_weights:
        return Resampler(ratios, None, id_col, text_col)
    k = weights.where(F.col("weight") >= F.lit(_cut(good_weights, bad_weights))).count()
    threshold = _kth_largest(weights.select(steps(F.col("weight") + F.col("noise")).alias("value")), k)
    return Resampler(ratios, threshold, id_col, text_col)


def _perturbed(docs: DataFrame, model: Resampler) -> tuple[DataFrame, str, str]:
    weight, value = unused(docs, "weight", "perturbed")
    return docs.withColumn(weight, model.log_weight()).withColumn(value, F.col(weight) + model.noise()), weight, value


def quality_report(docs: DataFrame, model: Resampler) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, score (0 to 1), perturbed (in steps), kept, held_out."""
    rows, weight, value = _perturbed(docs, model)
    return rows.select(
        F.col(f"`{model.id_col}`").alias("doc_id"),
        F.col(weight).alias("log_weight"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(weight))), 6).alias("score"),
        (steps(F.col(value)) / F.lit(float(STEPS))).alias("perturbed"),
        model.kept(F.col(value)).alias("kept"),
        held_out(F.col(f"`{model.id_col}`")).alias("held_out"),
    )


def resampled(docs: DataFrame, model: Resampler) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    rows, _, value = _perturbed(docs, model)
    return rows.where(model.kept(F.col(value))).select(*[F.col(f"`{c}`") for c in docs.columns])
