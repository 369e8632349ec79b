"""Exact deduplication against a persistent digest index.

Texts are equal when identical after deleting the characters
``[\\x20\\x09-\\x0D]``; they are compared by the SHA-256 of what is left.

``DigestIndex`` is a table of all digests seen so far, bucketed and sorted by
digest. ``dedup_batch`` groups a batch by digest (map-side partial
aggregates, so a digest that fills a third of the batch leaves each task as
one row), finds the digests that the index lacks by a sort-merge anti-join on
the buckets and appends those. Its answer is the batch joined to the index.

Of equal texts within a batch the row with the most code points stays, then
the smallest id (null ids last); of rows repeated with the same id and text,
one. A text the index already has from an earlier batch keeps its earlier
row, and all rows of the new batch with it go. ``table_report`` instead takes a
whole table through an index in several batches and lets the best row of all
win, whichever batch has it: a batch appends a digest that the index lacks or
has by a lesser row only, and the best one is taken over the index. Null text counts as empty, and
empty texts are equal to each other. An empty batch gives an empty answer.
Running a batch again under the same batch name gives the same answer.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import one_per_key, scratch_path, text_of, unused, written

# [\x20\x09-\x0D]
WHITE_SPACE = " \t\n\x0b\x0c\r"
# Batches in which a report feeds its table into its index.
BATCHES = 4
# Rows of a first batch per index bucket, when the number of buckets is not given.
ROWS_PER_BUCKET = 200_000
# Spark takes 100,000 buckets at most; beyond this buckets hold more rows.
MOST_BUCKETS = 65_536


def normalised(text: Column) -> Column:
    for character in WHITE_SPACE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A digest index kept as a bucketed table at ``path``, known to the session as ``table``."""

    spark: SparkSession
    path: str
    buckets: int
    table: str

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int, id_type: str = "bigint") -> DigestIndex:
        """The index at ``path``: a new one, or (same number of buckets) the one written there earlier."""
        table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id {id_type}, keep_chars INT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return DigestIndex(spark, path, buckets, table)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Drop the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id", "keep_chars", "batch").write.insertInto(self.table)


def buckets_for(rows: int) -> int:
    """A power of two from 16 to ``MOST_BUCKETS``, for about ``ROWS_PER_BUCKET`` rows in a bucket."""
    return min(MOST_BUCKETS, max(16, 1 << (max(1, rows // ROWS_PER_BUCKET) - 1).bit_length()))


def _batch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, doc_id, chars, copies): the batch without texts, rows repeated in full counted."""
    text = text_of(text_col)
    return (
        docs.select(text_digest(text).alias("digest"), F.col(f"`{id_col}`").alias("doc_id"), F.length(text).alias("chars"))
        .groupBy("digest", "doc_id", "chars")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def dedup_batch(
    docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Deduplicate a batch against itself and the index, and append its new digests.

    Returns (rows, groups), both written tables: rows are (digest, doc_id,
    chars, copies); groups have one row per digest of the batch with its
    group_size, the keep_id and keep_chars of the row that stays, and whether
    that row is ``own`` (of this batch).
    """
    rows = written(_batch_rows(docs, id_col, text_col), "batch")
    best = F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")))
    groups = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"), best.alias("best"))
    # Dealt out as the index's buckets are: the index is not shuffled, and each task appends to one bucket.
    groups = groups.repartition(index.buckets, "digest")
    fresh = groups.select(
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.shorter")).cast("int").alias("keep_chars"),
        F.lit(batch).alias("batch"),
    )
    index.append(fresh.hint("merge").join(index.rows().select("digest"), "digest", "left_anti"))
    resolved = (
        groups.select("digest", "group_size")
        .join(index.rows(), "digest")
        .select("digest", "group_size", "keep_id", "keep_chars", (F.col("batch") == F.lit(batch)).alias("own"))
    )
    return rows, written(resolved, "groups")


def _deduplicated(docs: DataFrame, index: DigestIndex | None, batch: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``dedup_batch`` with the given index, or with one of its own."""
    if index is not None:
        return dedup_batch(docs, index, batch, id_col, text_col)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = DigestIndex.open(spark, scratch_path(spark, "digest-index"), buckets_for(docs.count()), kind)
    try:
        return dedup_batch(docs, own, batch, id_col, text_col)
    finally:
        own.forget()


def dedup_report(
    docs: DataFrame,
    index: DigestIndex | None = None,
    batch: str = "first",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index a new one is started. Both sides of the last join are
    written tables, so the join's exchanges split a digest that fills a third
    of the rows.
    """
    rows, groups = _deduplicated(docs, index, batch, id_col, text_col)
    stays = F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return (
        rows.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (stays & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def _feed(groups: DataFrame, index: DigestIndex, batch: str) -> None:
    """Append the (digest, keep_id, keep_chars) that the index lacks, or has by a lesser row only."""
    fresh = groups.repartition(index.buckets, "digest").select("digest", "keep_id", "keep_chars", F.lit(batch).alias("batch"))
    there = index.rows().select(*[F.col(c).alias(f"there_{c}") for c in ("digest", "keep_id", "keep_chars")])
    longer = F.col("there_keep_chars") > F.col("keep_chars")
    same = F.col("there_keep_chars") == F.col("keep_chars")
    as_good = longer | (same & (F.col("keep_id").isNull() | (F.col("there_keep_id") <= F.col("keep_id"))))
    index.append(fresh.hint("merge").join(there, (F.col("digest") == F.col("there_digest")) & as_good, "left_anti"))


def _best(chars: str, doc_id: str) -> Column:
    return F.min(F.struct((-F.col(chars)).alias("shorter"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id")))


def _of_best() -> list[Column]:
    return [F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).cast("int").alias("keep_chars")]


def table_report(
    docs: DataFrame,
    batches: int = BATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The rows go into a new index in ``batches``, dealt out by a hash, so that
    copies meet the index from the second batch on. Both sides of the last
    join are written tables, so the join's exchanges split a digest that fills
    a third of the rows.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("digest", "doc_id", "chars"), F.lit(batches)).cast("int")
    rows = written(_batch_rows(docs, id_col, text_col).withColumn("part", part), "rows")
    kind = docs.schema[id_col].dataType.simpleString()
    index = DigestIndex.open(spark, scratch_path(spark, "digest-index"), buckets_for(rows.count()), kind)
    try:
        for n in range(batches):
            own = rows.where(F.col("part") == n).groupBy("digest").agg(_best("chars", "doc_id").alias("best"))
            _feed(own.select("digest", *_of_best()), index, str(n))
        best = index.rows().groupBy("digest").agg(_best("keep_chars", "keep_id").alias("best"))
        sizes = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
        groups = written(sizes.join(best.select("digest", *_of_best()), "digest"), "groups")
    finally:
        index.forget()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return (
        rows.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (stays & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(
    docs: DataFrame,
    index: DigestIndex | None = None,
    batch: str = "first",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The text moves once: rows are dealt out by (digest, id, length), where
    repeats of one row fall together, and meet the kept keys there.
    """
    _, groups = _deduplicated(docs, index, batch, id_col, text_col)
    (key,) = unused(docs, "key")

    def spelled(digest: Column, chars: Column, doc_id: Column) -> Column:
        return F.concat_ws(":", F.hex(digest), chars.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))

    text = text_of(text_col)
    keyed = one_per_key(docs.withColumn(key, spelled(text_digest(text), F.length(text), F.col(f"`{id_col}`"))), key)
    kept = groups.where("own").select(spelled(F.col("digest"), F.col("keep_chars"), F.col("keep_id")).alias(key))
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
