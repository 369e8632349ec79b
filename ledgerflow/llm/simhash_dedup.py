"""Near-duplicates by 64-bit SimHash fingerprints, linked through BK-trees.

Fingerprint
    A-Z are lower-cased, words are runs outside ``[\\x20\\x09-\\x0D]``, and
    each run of ``shingle`` words joined by spaces (repeats included; all
    words if there are fewer) is hashed by XXH64 with seed 42. A bit is set
    if it is set in over half of the hashes. Texts without a word (null and
    empty ones too) have fingerprint zero and are linked like any other.

Links
    Fingerprints with at most ``max_bits`` differing bits are linked.
    Cut into ``max_bits + 2`` blocks, two linked fingerprints agree on two
    whole blocks at least; every pair of blocks and their values names a
    shard, so all links lie within shards and none is lost. Each shard's
    distinct fingerprints form a BK-tree that the shard's own fingerprints
    search. A tree broadcast from the driver would hold fingerprints of the
    whole corpus, so shard trees are grown in the tasks to which the shuffle
    brings their queries. A shard over ``TREE_NODES`` is cut into several
    trees by a hash, and every part searches every tree of its shard, each
    pair of parts in a task of its own; no task holds over two parts.

    What leaves a tree is a spanning forest of its links (one row per linked
    fingerprint), never the pairs. Components are found by hooking each
    fingerprint to the smallest label around it and jumping to the label's
    label, in written rounds until no label changes.

Results
    ``component_id`` is the smallest doc_id reachable, itself included (null
    if all are null). Rows repeated or with equal fingerprints share it. An
    empty table gives an empty answer.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.bktree import Forest, lowest_linked
from ledgerflow.llm.common import one_per_key, prepare, row_key, text_of, unused, written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
# Most fingerprints in one tree (about; shards beyond it are cut by a hash).
TREE_NODES = 4096
# Fingerprints whose trees a task grows together.
FOREST_ROWS = 1 << 16
# Hashes whose bits are counted together.
BLOCK = 1 << 15


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    width = min(shingle, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK]).view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (doc_id, row_key, fp) with a row per row of ``docs``."""
    prepare(docs.sparkSession)

    def hashed(batches):
        for batch in batches:
            codes = np.fromiter((simhash(t, shingle) for t in batch.column(2).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes)], ["doc_id", "row_key", "fp"])

    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_of(text_col).alias("text"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("row_key", T.StringType()), T.StructField("fp", T.LongType())])
    return written(given.mapInArrow(hashed, schema), "simhash")


def _blocks(max_bits: int) -> list[int]:
    """Masks of ``max_bits + 2`` blocks that make up the 64 bits."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shard_rows(codes: DataFrame, max_bits: int) -> DataFrame:
    """(pair, bits, fp): every fingerprint in each of its shards."""
    masks = [a | b for a, b in combinations(_blocks(max_bits), 2)]
    shards = F.array(
        *[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)]
    )
    return codes.select("fp", F.explode(shards).alias("shard")).select("shard.pair", "shard.bits", "fp")


def _dealt(codes: DataFrame, max_bits: int, tree_nodes: int) -> DataFrame:
    """(pair, bits, low, high, part, fp): rows of one (pair, bits, low, high) meet in a task.

    Shards of up to ``tree_nodes`` are one part, 0; others are cut into parts,
    and each two parts meet once.
    """
    rows = _shard_rows(codes, max_bits)
    large = written(rows.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_nodes), "large-shards")
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(tree_nodes)), F.lit(1)).cast("int")
    cut = rows.join(large, ["pair", "bits"], "left").select(
        "pair", "bits", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part")
    )
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least(F.col("part"), other).alias("low"), F.greatest(F.col("part"), other).alias("high")),
    )
    return cut.select("pair", "bits", "part", "fp", F.explode(meetings).alias("m")).select(
        "pair", "bits", "m.low", "m.high", "part", "fp"
    )


def _links(codes: DataFrame, max_bits: int, tree_nodes: int) -> DataFrame:
    """Written table of distinct (fp, linked) that spans every shard's links."""

    def linked(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """frame: rows (pair, bits, low, high, part, fp) of whole meetings, sorted."""
        meeting = frame[:, :4]
        group = np.r_[0, np.cumsum((meeting[1:] != meeting[:-1]).any(axis=1))]
        keep = (np.bincount(group) > 1)[group]
        frame, group = frame[keep], group[keep]
        if not len(frame):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = frame[:, 5].copy().view(np.uint64)
        in_tree = np.flatnonzero(frame[:, 4] == frame[:, 2])
        asking = np.flatnonzero(frame[:, 4] == frame[:, 3])
        forest = Forest(codes[in_tree], group[in_tree])
        found = forest.within(codes[asking], group[asking], max_bits)
        root = lowest_linked(len(frame), ((asking[q], in_tree[n]) for q, n in found))
        moved = np.flatnonzero(root != np.arange(len(frame)))
        return frame[moved, 5], frame[root[moved], 5]

    def search(batches):
        held: list[np.ndarray] = []
        size = 0

        def result(frame):
            a, b = linked(frame)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp", "linked"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            held.append(rows)
            size += len(rows)
            if size < FOREST_ROWS:
                continue
            frame = np.concatenate(held)
            differs = np.flatnonzero((frame[1:, :4] != frame[:-1, :4]).any(axis=1))
            last = int(differs[-1]) + 1 if len(differs) else 0  # the last meeting may go on
            if last:
                yield result(frame[:last])
            held, size = [frame[last:]], len(frame) - last
        if size:
            yield result(np.concatenate(held))

    keys = ["pair", "bits", "low", "high"]
    met = _dealt(codes, max_bits, tree_nodes).repartition(*keys).sortWithinPartitions(*keys, "part")
    return written(met.mapInArrow(search, "fp bigint, linked bigint").distinct(), "links")


def _labels(links: DataFrame) -> DataFrame:
    """Written table (fp, label) of all linked fingerprints: the smallest fingerprint of each component."""
    edges = written(links.unionByName(links.select(F.col("linked").alias("fp"), F.col("fp").alias("linked"))), "edges")
    labels = written(edges.groupBy("fp").agg(F.least(F.min("linked"), F.col("fp")).alias("label")), "labels")
    while True:
        around = edges.join(labels.select(F.col("fp").alias("linked"), "label"), "linked").select("fp", "label")
        lowest = (
            around.unionByName(labels.select("fp", "label"))
            .groupBy("fp")
            .agg(F.min("label").alias("lowest"))
        )
        jump = labels.select(F.col("fp").alias("lowest"), F.col("label").alias("beyond"))
        after = (
            lowest.join(jump, "lowest")
            .join(labels.select("fp", F.col("label").alias("before")), "fp")
            .select("fp", "beyond", (F.col("beyond") != F.col("before")).alias("changed"))
        )
        stepped = written(after, "labels")
        labels = stepped.select("fp", F.col("beyond").alias("label"))
        if stepped.where("changed").isEmpty():
            return labels


def components(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    tree_nodes: int = TREE_NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes), both written: rows (doc_id, row_key, fp); classes (fp, component_id, keep_key)."""
    rows = fingerprints(docs, shingle, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))).alias("first")
    codes = written(rows.groupBy("fp").agg(first), "codes")
    labels = _labels(_links(codes.select("fp"), max_bits, tree_nodes))
    labelled = codes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    lowest = labelled.groupBy("label").agg(F.min("first").alias("lowest"))
    classes = labelled.join(lowest, "label").select(
        "fp", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row_key").alias("keep_key")
    )
    return rows, written(classes, "classes")


def simhash_report(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, **columns: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows, classes = components(docs, shingle, max_bits, **columns)
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The first row (by id, nulls last) of each component, with all its columns."""
    _, classes = components(docs, shingle, max_bits, id_col=id_col, text_col=text_col)
    (key,) = unused(docs, "key")
    keep = classes.select(F.col("keep_key").alias(key)).distinct()
    one = one_per_key(docs.withColumn(key, row_key(id_col, text_col)), key)
    return one.join(keep, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
