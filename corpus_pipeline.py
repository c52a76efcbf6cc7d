"""From raw documents to packed training sequences: STAGES, each reading all that its predecessor kept.

Stages take and return the columns of ``documents`` (whatever they are beside doc_id and text), the last one returns
places in sequences. Each stage decides on its own input: counts, statistics and groups are those of what came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from tablegauge.llm.shared import read_table, staged, word_vocabulary

# Stages on word shingles take five words.
NEAR = near_dedup.Settings(words=5, percent=80)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely good than not by the votes of all rules."""
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return near_dedup.keep_one(docs, NEAR)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 ids."""
    made = packing.pack_documents(docs, word_vocabulary())
    return made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# Expectation-maximisation, connected components and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
