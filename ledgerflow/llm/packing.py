"""Hierarchical residual best-fit packing of token sequences.

A document becomes its ids and an end id. One longer than ``capacity`` is
cut, the first piece taking what does not fill a whole one; whole pieces are
sequences of their own. The others are packed:

1. Each task packs its own pieces by best fit, longest first. Bins filled to
   ``capacity - slack`` at least are done.
2. The underfull bins are items of the next round. They are dealt anew to
   fewer tasks of about ``ITEMS_PER_TASK`` items, packed by best fit, the
   nearly full bins leave, and the rest go on, until they fit into one task
   or ``IDLE_ROUNDS`` in a row save nothing.

Only (bin, size) moves between rounds. Each round's (bin, into, offset) is
written; at the end the rounds' placements are joined from the last to the
first and then to the pieces.

Null text counts as empty; a document always has its end id, so an empty one
is a piece of one token. Rows repeated or with equal or null ids are packed
each for itself. An empty table gives no sequences.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.bpe import PATTERN, byte_characters
from ledgerflow.llm.common import prepare, text_of, written

CAPACITY = 1024
END_ID = 2
# Free tokens up to which a bin counts as nearly full.
SLACK = 4
ITEMS_PER_TASK = 50_000
# Documents whose ids a task holds besides the pieces it has yet to pack.
DOCS_AT_ONCE = 500
# Rounds in a row, each dealt anew, that may save no bin before the rest counts as packed.
IDLE_ROUNDS = 3
# A round's number is part of its bins' names.
MOST_ROUNDS = 127


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A function from a text to its ids as a numpy array; special tokens in the text are recognised."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    spelled = byte_characters()
    ranks = {bytes(spelled[c] for c in word): token for word, token in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


def best_fit(sizes, capacity: int):
    """Best fit, longest first: for every item its bin, the offset in it, and the bins' fill (numpy arrays).

    Bins are kept by what is free in them, with a bit set for each free size that any bin has.
    """
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, fill = 0, []
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = present >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            place = by_free[free].pop()
            if not by_free[free]:
                present &= ~(1 << free)
        else:
            place, free = len(fill), capacity
            fill.append(0)
        bin_of[item], offset[item] = place, fill[place]
        fill[place] += size
        left = free - size
        if left:
            by_free[left].append(place)
            present |= 1 << left
    return bin_of, offset, np.asarray(fill, np.int64)


def _cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces."""
    first = n % capacity
    edges = [0, *range(first or capacity, n + 1, capacity)]
    return list(zip(edges, edges[1:]))


def _first_round(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, slack: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], bin, fill, offset), written; each task packs what it cuts."""
    prepare(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    fields = [given.schema["doc_id"], T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "bin", "fill", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut_and_pack(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        names = [f.name for f in fields]
        id_type, used = None, 0
        waiting: list[tuple] = []

        def rows(pieces, bins, fills, offsets):
            columns = list(zip(*pieces)) if pieces else [()] * (6 if with_ids else 5)
            arrays = [pa.array(columns[0], id_type), pa.array(columns[1], pa.int32())]
            arrays += [pa.array(np.asarray(c, np.int64)) for c in columns[2:5]]
            arrays += [pa.array(np.asarray(c, np.int64)) for c in (bins, fills, offsets)]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in (b.slice(i, DOCS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCS_AT_ONCE)):
            id_type = batch.column(0).type
            whole: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for piece, (start, end) in enumerate(_cuts(len(ids), capacity)):
                    part = ids[start:end]
                    row = (doc_id, piece, start, end - start, crc32(part.tobytes()))
                    row += (part.astype(np.int32),) if with_ids else ()
                    (whole if end - start == capacity else waiting).append(row)
            if whole:
                bins = base + used + np.arange(len(whole))
                used += len(whole)
                yield rows(whole, bins, [capacity] * len(whole), [0] * len(whole))
        if waiting:
            place, offset, fill = best_fit([w[3] for w in waiting], capacity)
            for i in range(0, len(waiting), 10_000):
                part = slice(i, i + 10_000)
                yield rows(waiting[part], base + used + place[part], fill[place[part]], offset[part])

    return written(given.mapInArrow(cut_and_pack, T.StructType(fields)), "pieces")


def _merge_round(bins: DataFrame, tasks: int, capacity: int, number: int) -> DataFrame:
    """(bin, size) -> written (bin, size, into, offset, fill): underfull bins packed as items."""

    def pack(frame):
        place, offset, fill = best_fit(frame["size"], capacity)
        name = (number << 56) | (int(frame["task"].iloc[0]) << 32)
        return frame[["bin", "size"]].assign(into=place + name, offset=offset, fill=fill[place])

    dealt = bins.withColumn("task", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(tasks)).cast("int"))
    return written(dealt.groupBy("task").applyInPandas(pack, "bin long, size long, into long, offset long, fill long"), "merged")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    slack: int = SLACK,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    items_per_task: int = ITEMS_PER_TASK,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for."""
    pieces = _first_round(docs, tokenizer, end_id, capacity, slack, with_ids, id_col, text_col)
    done = F.col("fill") >= capacity - slack
    going = pieces.where(~done).select("bin", F.col("fill").alias("size")).distinct()
    rounds: list[DataFrame] = []
    count, idle = going.count(), 0
    while count:
        tasks = max(1, -(-count // items_per_task))
        rounds.append(_merge_round(going, tasks, capacity, len(rounds) + 1))
        going = rounds[-1].where(~done).select(F.col("into").alias("bin"), F.col("fill").alias("size")).distinct()
        left = rounds[-1].select("into").distinct().count()
        idle = idle + 1 if left == count else 0
        if tasks == 1 or idle == IDLE_ROUNDS or len(rounds) == MOST_ROUNDS:
            break
        count = going.count()
    placed = None  # of each bin of the round at hand: the sequence it ends in, and its offset there
    for merged in reversed(rounds):
        here = merged.select("bin", "into", "offset")
        if placed is not None:
            above = placed.select(F.col("bin").alias("into"), "sequence_id", F.col("base").alias("above"))
            here = here.join(above, "into", "left")
        else:
            here = here.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("above"))
        placed = here.select(
            "bin", F.coalesce("sequence_id", "into").alias("sequence_id"), (F.col("offset") + F.coalesce("above", F.lit(0))).alias("base")
        )
    if placed is not None:
        pieces = pieces.join(placed, "bin", "left")
    else:
        pieces = pieces.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("base"))
    return pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )
