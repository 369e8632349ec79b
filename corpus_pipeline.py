"""The corpus pipeline: documents in, packed token sequences out.

Five stages, each a registered operator of ``ledgerflow.llm`` with its
production parameters, on all rows that the stage before kept. A stage takes
``(spark, docs, sf_dir)``; its result is written as Parquet under the shared
folder and read again for the next one. All but the last return the columns
of ``docs``; the last returns a row per piece of a sequence, with its ids.

Null texts count as empty throughout; an empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import resampling, toxicity
from ledgerflow.llm.common import read_documents, written
from ledgerflow.llm.exact_dedup import drop_duplicates
from ledgerflow.llm.packing import pack
from ledgerflow.llm.queries import tokenizer_file
from ledgerflow.llm.simhash_dedup import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the rows labelled good; what is not drawn goes."""
    return resampling.resampled(docs, resampling.fit(docs, read_documents(spark, sf_dir, "labels")))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_documents(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays."""
    return drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays."""
    return drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

# Neither the learnt stages nor the tokenizer can be written in SQL; tests check each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to sequences."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
