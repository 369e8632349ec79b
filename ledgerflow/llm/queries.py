"""The registered queries of this folder: each operator on its whole test table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, toxicity
from ledgerflow.llm.collocations import collocations, collocations_sql
from ledgerflow.llm.common import read_documents
from ledgerflow.llm.decomposition import decompose
from ledgerflow.llm.exact_dedup import table_report
from ledgerflow.llm.fim import fim_report, fim_sql
from ledgerflow.llm.imatch import imatch_report
from ledgerflow.llm.license_scan import BASE_PHRASES, BASE_WEIGHT, license_report, rules
from ledgerflow.llm.merkle import fixity_report
from ledgerflow.llm.oracle_hashing import CRC_TABLE, crc32, imatch_sql, resampling_sql, simhash_sql
from ledgerflow.llm.packing import pack
from ledgerflow.llm.resampling import fit, quality_report
from ledgerflow.llm.rendezvous import with_shards, with_slots
from ledgerflow.llm.simhash_dedup import simhash_report

SHARDS = 16


def tokenizer_file() -> str:
    """The byte-level BPE among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return toxicity.toxicity_report(docs, toxicity.fit(docs, read_documents(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), tokenizer_file(), with_ids=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_documents(spark, sf_dir))


def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return quality_report(docs, fit(docs, read_documents(spark, sf_dir, "labels")))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' archive against a replica with damage at known places.

    Of the pages whose id mod 211 is 0 the replica's body differs in its first character; those whose mod is 1 are lost.
    """
    pages = read_documents(spark, sf_dir, "pages")
    place = F.col("page_id") % 211
    damaged = F.when(place == 0, F.overlay("html", F.lit("\x00"), F.lit(1), F.lit(1))).otherwise(F.col("html"))
    return fixity_report(pages, damaged, place == 1)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_documents(spark, sf_dir), tokenizer_file())


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = with_slots(with_shards(read_documents(spark, sf_dir), [1.0] * SHARDS))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint"), "grown_shard"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_report(read_documents(spark, sf_dir))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_report(read_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(read_documents(spark, sf_dir))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_report(read_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_documents(spark, sf_dir))


def op13_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose(read_documents(spark, sf_dir), tokenizer_file(), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_resampling": op4_resampling,
    "op5_merkle": op5_merkle,
    "op6_bpe": op6_bpe,
    "op7_rendezvous": op7_rendezvous,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_imatch": op9_imatch,
    "op10_simhash": op10_simhash,
    "op11_fim": op11_fim,
    "op12_collocations": op12_collocations,
    "op13_decomposition": op13_decomposition,
}

def license_sql() -> str:
    """The license scan for DuckDB. Words stand between two spaces there, so that neighbouring matches share none."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def row(number: int, keyword: str, regex: str, label: str, priority: int, weight: float) -> str:
        apart = lambda s: " " + s.replace(" ", "  ") + " "
        return f"({number}, {quoted(apart(keyword))}, {quoted(apart(regex))}, {quoted(label)}, {priority}, {weight})"

    listed = [row(n, r.keyword, r.regex, r.label, r.priority, r.weight) for n, r in enumerate(rules())]
    # Base phrases: priority 0 marks them.
    listed += [row(-n, phrase, phrase, label, 0, BASE_WEIGHT) for n, (phrase, label) in enumerate(BASE_PHRASES.items(), 1)]
    priorities = sorted({r.priority for r in rules()})
    contained = " OR ".join(
        f"(priority <= {p} AND max(CASE WHEN priority >= {p} THEN last END) OVER before >= last)" for p in priorities
    )
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH rules(number, keyword, regex, label, priority, weight) AS (VALUES {", ".join(listed)}),
        texts AS (
            SELECT doc_id, row_number() OVER () AS place,
                   regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), lines AS (
            SELECT *, CASE WHEN len(words) = 0 THEN '' ELSE ' ' || array_to_string(words, '  ') || ' ' END AS line FROM texts
        ), matched AS (
            SELECT place, number, label, priority, weight,
                   list_transform(regexp_extract_all(line, regex), lambda m: (len(m) - len(replace(m, ' ', ''))) // 2) AS sizes,
                   list_transform(string_split_regex(line, regex), lambda s: (len(s) - len(replace(s, ' ', ''))) // 2) AS gaps
            FROM lines JOIN rules ON contains(line, keyword)
        ), numbered AS (
            SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM matched
        ), found AS (
            SELECT place, number, label, priority, weight,
                   list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS first,
                   list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS last
            FROM numbered
        ), judged AS (
            SELECT *, coalesce({contained}, false) AS gone FROM found WHERE priority > 0
            WINDOW before AS (PARTITION BY place ORDER BY first, last DESC, priority DESC, number
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), base AS (
            SELECT place, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM found WHERE priority = 0 GROUP BY place
        ), kept AS (
            SELECT place, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
            FROM (SELECT place, label, weight FROM judged WHERE NOT gone
                  UNION ALL SELECT place, label, weight FROM found WHERE priority = 0) GROUP BY place
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
               CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM lines LEFT JOIN base USING (place) LEFT JOIN kept USING (place)
    """


ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_sql(),
    "op4_resampling": resampling_sql(),
    "op5_merkle": r"""
        WITH records AS (
            SELECT page_id,
                   'WARC/1.0' || e || 'WARC-Type: resource' || e
                   || CASE WHEN page_id IS NULL THEN '' ELSE 'WARC-Record-ID: <urn:page:' || page_id || '>' || e END
                   || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e
                   || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record
            FROM pages, (SELECT chr(13) || chr(10) AS e)
        ), hashed AS (
            SELECT min(page_id) AS page_id, count(*) AS copies, sha256(record) AS record_sha256, max(strlen(record)) AS length
            FROM records GROUP BY sha256(record)
        ), placed AS (
            SELECT *, CAST(('0x' || substr(record_sha256, 1, 8))::BIGINT
                      >> (32 - greatest(0, ceil(log2(greatest(1, count(*) OVER ()) / 1024.0)))::INT) AS INTEGER) AS segment
            FROM hashed
        )
        SELECT page_id, copies, segment, length, record_sha256,
               CAST(coalesce(sum(length) OVER (PARTITION BY segment ORDER BY record_sha256
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
               CASE page_id % 211 WHEN 0 THEN 'changed' WHEN 1 THEN 'lost' ELSE 'intact' END AS state
        FROM placed
    """,
    "op7_rendezvous": f"""
        WITH {CRC_TABLE}, rows AS (
            SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id IS NULL THEN 'n' ELSE 'k' || doc_id END AS key
            FROM documents
        ), hashed AS (
            SELECT doc_id, key, strlen(text) + 1 AS size, {crc32("text")} AS text_crc32, {crc32("key")} AS key_crc32
            FROM rows, crc_table
        ), scores AS (
            SELECT key, list(CAST('0x' || substr(sha256(key || '#' || s), 1, 13) AS BIGINT) ORDER BY s) AS score
            FROM (SELECT DISTINCT key FROM rows), range(17) r(s) GROUP BY key
        ), placed AS (
            SELECT doc_id, size, text_crc32, (text_crc32 + key_crc32) % 1024 AS run, score[17] > list_max(score[1:16]) AS moves,
                   CAST(list_position(score[1:16], list_max(score[1:16])) - 1 AS INTEGER) AS shard
            FROM hashed JOIN scores USING (key)
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(CASE WHEN moves THEN 16 ELSE shard END AS INTEGER) AS grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY run, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
        FROM placed
    """,
    "op8_exact_dedup": r"""
        WITH normalised AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER best = 1 AS kept,
               text_sha256
        FROM normalised
        WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
    """,
    "op9_imatch": imatch_sql(),
    "op10_simhash": simhash_sql(),
    "op11_fim": fim_sql(),
    "op12_collocations": collocations_sql(),
}
