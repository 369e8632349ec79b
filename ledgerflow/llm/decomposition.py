"""Packing by power-of-two decomposition.

A document becomes its ids and an end id. It is split into pieces whose
lengths are powers of two: as many of ``longest`` as it holds, then those of
the binary digits of the rest, longest first. Each piece is a sequence of its
own, so no sequence crosses documents and none needs padding. Pieces of equal
length form a bucket (the length); a training step draws its batch from one
bucket. ``numbered`` deals a bucket's sequences into batches of equal token
count; ``write_buckets`` stores a folder per bucket.

``sequence_id`` is (number of the task << 40 | number in the task): unique in
one result, made without a shuffle. ``numbered`` gives gapless numbers.

Null text counts as empty; a document always has its end id, so an empty one
is one piece of one token. Repeated rows and rows with equal or null ids are
split each for itself; an empty table gives no pieces. A task holds the ids of
``DOCS_AT_ONCE`` documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import prepare, text_of, written
from ledgerflow.llm.packing import load_encoder

LONGEST = 2048
END_ID = 1
DOCS_AT_ONCE = 200
# Runs into which a bucket is cut to be numbered.
RUNS = 1024


def pieces_of(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    lengths = [longest] * (n // longest)
    lengths += [1 << bit for bit in reversed(range(longest.bit_length() - 1)) if n % longest >> bit & 1]
    starts = [0]
    for length in lengths:
        starts.append(starts[-1] + length)
    return list(zip(starts, lengths))


def decompose(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    longest: int = LONGEST,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), and its ids if asked for.

    ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"{longest} is no power of two")
    prepare(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [given.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in longs]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def split(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in (b.slice(i, DOCS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCS_AT_ONCE)):
            of_row, rows, ids = [], [], []
            for row, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py()).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for start, length in pieces_of(len(tokens), longest):
                    part = tokens[start : start + length]
                    of_row.append(row)
                    rows.append((start, length, crc32(part), len(tokens), number, 0))
                    number += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
            if not rows:
                continue
            columns = [batch.column(0).take(pa.array(of_row, pa.int64()))]
            columns += [pa.array(np.array(c, np.int64)) for c in zip(*rows)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return given.mapInArrow(split, T.StructType(fields))


def numbered(pieces: DataFrame, tokens_per_batch: int = 64 * LONGEST) -> DataFrame:
    """The pieces, written, with ``place`` (gapless from 0 in the bucket of their length) and ``batch`` (of equal token counts).

    A bucket's pieces are dealt to ``RUNS`` runs by a hash, which also mixes
    them; the runs' sizes say where each starts, so no bucket is gathered
    into one task. The last batch of a bucket may be smaller.
    """
    # A number of the piece itself, so that it falls into the same run however often a task is run.
    run = F.pmod(F.xxhash64("ids_crc32", "doc_id", "start"), F.lit(RUNS)).cast("int")
    dealt = written(pieces.withColumn("run", run), "pieces")
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "run").agg(F.count(F.lit(1)).alias("size"))  # RUNS rows per bucket at most
    starts = sizes.select("length", "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "run").orderBy("ids_crc32", "doc_id", "start", "sequence_id"))
    placed = dealt.withColumn("within", within).join(starts, ["length", "run"])
    return placed.withColumn("place", F.col("first") + F.col("within") - 1).select(
        *pieces.columns, "place", F.floor(F.col("place") * F.col("length") / F.lit(tokens_per_batch)).cast("bigint").alias("batch")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store the pieces in a folder per length; a hot bucket is written by many tasks."""
    pieces.withColumn("bucket", F.col("length")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
