"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.common import materialize, table
from quarrymill.llm.mixing import sample_mix
from quarrymill.llm.packing import pack
from quarrymill.llm.quality import keep_good
from quarrymill.llm.queries import small_batches
from quarrymill.llm.simhash import drop_near_duplicates
from quarrymill.llm.substring import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are robust outliers of their language and source."""
    small_batches(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; a document of which nothing is left goes."""
    small_batches(spark)
    return cut_repeats(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have their target shares."""
    return sample_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their tokens."""
    from public_tokenizers import path

    small_batches(spark)
    return pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("target_mix", target_mix),
    ("packed_sequences", packed_sequences),
]

#: Robust estimates, components of fingerprints and alignments have no SQL; tests hold run() against its operators
#: and brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
