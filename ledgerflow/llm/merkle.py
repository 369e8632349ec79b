"""Merkle fixity audit of a WARC archive's replicas.

Archive
    Each page is a WARC record. Records are stored once each (rows repeated in
    full are counted), in segments by the first bits of their SHA-256, within
    a segment in the order of their digests; a record's offset is the sum of
    the lengths before it. There are about ``SEGMENT_RECORDS`` records to a
    segment, whatever ids or hosts repeat.

Tree
    A leaf is a record: its offset, length and the SHA-256 of its bytes. The
    leaves that start in one range of ``RANGE_BYTES`` make a node, in order of
    offset; ``FANOUT`` neighbouring nodes of a segment make the next one, up
    to the segment's root; then ``FANOUT`` neighbouring segments, up to the
    archive's root. A node's hash covers its children's places and hashes.

Files
    ``write_archive`` writes each segment as one WARC file, its records at
    their offsets; ``file_leaves`` hashes what the files of a copy hold there.

Audit
    Replica roots are compared; from a pair that differs only its children are
    compared, and so on down, so that branches that agree are never entered.
    At the end stand the leaves that differ: changed, lost, or added.

Nulls: a null url or html is empty, a null id is left out of the record. An
empty archive has no root; two of them agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import one_per_key, written

SEGMENT_RECORDS = 1024
RANGE_BYTES = 65_536
FANOUT = 16
# Between two records of a file.
GAP = "\r\n\r\n"


def warc_record(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as text (stored in UTF-8)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\n"),
        F.when(record_id.isNull(), F.lit("")).otherwise(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), record_id.cast("string"), F.lit(">")))),
        line("WARC-Target-URI", F.coalesce(url.cast("string"), F.lit(""))),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit(GAP),
    )


def segment_bits(records: int) -> int:
    return max(0, math.ceil(math.log2(max(1, records) / SEGMENT_RECORDS)))


def laid_out(records: DataFrame) -> DataFrame:
    """Distinct records (digest, length, ...) with their segment and offset."""
    bits = segment_bits(records.count())
    if bits > 31:
        raise ValueError("over 2^31 segments")
    first = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    before = Window.partitionBy("segment").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("segment", F.shiftright(first, 32 - bits).cast("int")).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    )


def _parent(level: int, segment_levels: int) -> tuple[Column, Column]:
    """(segment, node) of the node above one of ``level``."""
    if level == 0:
        return F.col("segment"), F.floor(F.col("node") / RANGE_BYTES).cast("bigint")
    if level < segment_levels:
        return F.col("segment"), F.floor(F.col("node") / FANOUT).cast("bigint")
    return F.floor(F.col("segment") / FANOUT).cast("int"), F.lit(0).cast("bigint")


def levels_of(leaves: DataFrame) -> tuple[int, int]:
    """(level of the segments' roots, level of the archive's root) that hold all leaves."""
    top = leaves.agg(F.max("offset"), F.max("segment")).first()
    nodes, segments = (top[0] or 0) // RANGE_BYTES + 1, (top[1] or 0) + 1
    segment_levels, levels = 1, 0
    while nodes > 1:
        nodes, segment_levels = -(-nodes // FANOUT), segment_levels + 1
    levels = segment_levels
    while segments > 1:
        segments, levels = -(-segments // FANOUT), levels + 1
    return segment_levels, levels


def tree(leaves: DataFrame, levels: tuple[int, int]) -> list[DataFrame]:
    """Nodes (segment, node, hash) of every level from the leaves to the root, written; a leaf's node is its offset."""
    segment_levels, top = levels
    place = F.concat_ws(":", F.col("offset"), F.col("length"), F.col("digest"))
    nodes = [written(leaves.select("segment", F.col("offset").alias("node"), F.sha2(place, 256).alias("hash")), "leaves")]
    for level in range(top):
        segment, node = _parent(level, segment_levels)
        child = F.struct(F.col("segment").alias("s"), F.col("node").alias("n"), F.col("hash").alias("h"))
        spelled = F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat_ws(":", c["s"], c["n"], c["h"]))
        above = nodes[-1].select(segment.alias("segment"), node.alias("node"), child.alias("child"))
        # A node has FANOUT children, or the records that start within one range.
        nodes.append(written(above.groupBy("segment", "node").agg(F.sha2(F.concat_ws("\n", spelled), 256).alias("hash")), f"level-{level + 1}"))
    return nodes


def audit(ours: list[DataFrame], theirs: list[DataFrame], segment_levels: int) -> DataFrame:
    """(segment, node, ours, theirs) of the leaves that differ; a hash is null where there is no such leaf."""

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.select("segment", "node", F.col("hash").alias("ours")), b.select("segment", "node", F.col("hash").alias("theirs"))
        return a.join(b, ["segment", "node"], "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))

    top = len(ours) - 1
    found = differing(ours[top], theirs[top])
    for level in range(top - 1, -1, -1):
        if found.isEmpty():
            return found.limit(0) if level else found
        above = found.select(F.col("segment").alias("up_segment"), F.col("node").alias("up_node"))
        segment, node = _parent(level, segment_levels)

        def entered(nodes: DataFrame) -> DataFrame:
            placed = nodes.select("*", segment.alias("up_segment"), node.alias("up_node"))
            return placed.join(above, ["up_segment", "up_node"], "left_semi")

        found = written(differing(entered(ours[level]), entered(theirs[level])), f"differing-{level}")
    return found


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write the pages' archive under ``path``; returns its index (segment, offset, length, digest, copies, page_id).

    Records meet their place by digest and are written by the task that has
    their segment, in order of offset; each ends with the gap that the text
    writer puts after it.
    """
    identity, url, body = (F.col(f"`{c}`") for c in (id_col, url_col, body_col))
    record = warc_record(url, identity, body)
    rows = pages.select(identity.alias("page_id"), record.alias("record"), F.sha2(record, 256).alias("digest"))
    distinct = rows.groupBy("digest", F.octet_length("record").alias("length")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("page_id")
    )
    index = written(laid_out(written(distinct, "records")), "index")
    placed = one_per_key(rows.select("digest", "record"), "digest").join(index.select("digest", "segment", "offset"), "digest")
    ended = F.expr(f"substring(record, 1, length(record) - {len(GAP)})").alias("value")
    placed.repartition("segment").sortWithinPartitions("segment", "offset").select("segment", ended).write.option(
        "lineSep", GAP
    ).partitionBy("segment").text(path)
    return index


def file_leaves(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(segment, offset, length, digest) of what the archive files at ``path`` hold at the index's places.

    A file is met once, by the list of its places (about ``SEGMENT_RECORDS``);
    a place past a file's end, or of a file that is gone, has no leaf.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("segment").cast("int").alias("segment"), "content")
    places = index.groupBy("segment").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def read(place: Column) -> Column:
        held = F.substr(F.col("content"), (place["offset"] + 1).cast("int"), place["length"].cast("int"))
        whole = place["offset"] + place["length"] <= F.octet_length("content")
        return F.struct(place["offset"].alias("offset"), place["length"].alias("length"), F.when(whole, F.sha2(held, 256)).alias("digest"))

    leaves = places.join(files, "segment").select("segment", F.explode(F.transform("places", read)).alias("leaf"))
    return leaves.select("segment", "leaf.*").where(F.col("digest").isNotNull())


def audit_files(spark: SparkSession, path: str, other: str, index: DataFrame) -> DataFrame:
    """(segment, offset, page_id, record_sha256, state) of the index's records that the two copies hold differently.

    ``state``: changed, or lost where one of the copies has nothing.
    """
    levels = levels_of(index)
    found = audit(tree(file_leaves(spark, path, index), levels), tree(file_leaves(spark, other, index), levels), levels[0])
    state = F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "lost").otherwise("changed").alias("state")
    placed = found.withColumnRenamed("node", "offset")
    return index.join(placed, ["segment", "offset"]).select("segment", "offset", "page_id", F.col("digest").alias("record_sha256"), state)


def fixity_report(pages: DataFrame, replica_body: Column, replica_lost: Column, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Audit of an archive of ``pages`` against a replica that holds ``replica_body`` instead, without the ``replica_lost`` rows.

    One row per record: page_id, copies, segment, offset, length,
    record_sha256, state (intact, changed, lost); both columns are read
    from ``pages``.
    """
    identity, url, body = (F.col(f"`{c}`") for c in (id_col, url_col, body_col))
    record, copy = warc_record(url, identity, body), warc_record(url, identity, replica_body)
    rows = pages.select(
        identity.alias("page_id"),
        F.sha2(record, 256).alias("digest"),
        F.octet_length(record).alias("length"),
        F.when(~F.coalesce(replica_lost, F.lit(False)), F.sha2(copy, 256)).alias("copy_digest"),
        F.octet_length(copy).alias("copy_length"),
    )
    distinct = rows.groupBy("digest", "length").agg(
        F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("page_id"), F.min("copy_digest").alias("copy_digest"), F.min("copy_length").alias("copy_length")
    )
    archive = written(laid_out(written(distinct, "records")), "archive")
    replica = archive.where(F.col("copy_digest").isNotNull()).select("segment", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    levels = levels_of(archive)
    found = audit(tree(archive, levels), tree(replica, levels), levels[0])
    state = F.when(F.col("known").isNull(), "intact").when(F.col("theirs").isNull(), "lost").otherwise("changed")
    flagged = found.select("segment", F.col("node").alias("offset"), "theirs", F.lit(True).alias("known"))
    return archive.join(flagged, ["segment", "offset"], "left").select(
        "page_id", "copies", "segment", "offset", F.col("length").cast("bigint").alias("length"), F.col("digest").alias("record_sha256"), state.alias("state")
    )
