"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a hash (of SHA-256) that is uniform on (0, 1); a
shard's score for the key is ``weight / -ln(hash)`` and the key goes to the shard with the
highest score. A shard's scores do not depend on the other shards, so adding
one moves only the keys that it wins, and a shard's share is its weight's
share.

The key is the id spelled as text. A null id is a key of its own (all rows
with a null id go to one shard); rows that repeat a key go to its shard, each
with a slot of its own. Null text counts as empty. An empty table gives an
empty answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import text_of

# Slots are numbered in so many runs per shard, each run by a task of its own.
SLOT_RUNS = 1024


def record_key(id_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(f"`{id_col}`").cast("string")), F.lit("n"))


def shard_scores(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """array<struct<score, other_way>> of shards ``first`` on; of equal scores the smaller shard is the greater struct."""
    scores = []
    for shard, weight in enumerate(weights, start=first):
        if not weight > 0:
            raise ValueError("weights must be positive")
        bits = F.conv(F.substring(F.sha2(F.concat(key, F.lit(f"#{shard}")), 256), 1, 13), 16, 10).cast("bigint")
        uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)
        scores.append(F.struct((F.lit(float(weight)) / -F.ln(uniform)).alias("score"), F.lit(-shard).alias("other_way")))
    return F.array(*scores)


def with_shards(
    docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, run, shard, grown_shard) of every row; grown_shard: with one more shard.

    ``run`` is a hash of id and text, for ``with_slots``.
    """
    key, text = record_key(id_col), text_of(text_col)
    scored = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        ((F.crc32(text) + F.crc32(key)) % SLOT_RUNS).cast("int").alias("run"),
        F.array_max(shard_scores(key, weights)).alias("best"),
        shard_scores(key, [grown_weight], first=len(weights))[0].alias("added"),
    )
    shard = -F.col("best.other_way")
    grown = F.when(F.col("added") > F.col("best"), F.lit(len(weights))).otherwise(shard)
    return scored.select("doc_id", "size", "text_crc32", "run", shard.alias("shard"), grown.alias("grown_shard"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """``sharded`` with ``slot``, gapless from 0 in each shard.

    Rows repeated in full are counted first. Each shard is cut by ``run``
    into ``SLOT_RUNS`` runs; the runs' sizes (that many rows per shard) give
    where each starts, and each run numbers its own rows.
    """
    columns = [c for c in sharded.columns if c != "run"]
    counted = sharded.groupBy(*sharded.columns).agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy("shard", "run")
        .agg(F.sum("copies").alias("rows"))
        .select("shard", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    placed = counted.join(starts, ["shard", "run"]).withColumn(
        "first", F.col("start") + F.sum("copies").over(within) - F.col("copies")
    )
    return placed.select(
        *columns, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot")
    )
