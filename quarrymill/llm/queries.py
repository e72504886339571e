"""The dealt queries: each applies its operator to its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import chat, mixing, topk, urlfilter
from quarrymill.llm.common import table

#: Rows of one Arrow batch: keeps Python's memory bounded when texts are long.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def op1_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("probability", F.round("probability", 6))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.simhash import near_duplicates

    found = near_duplicates(table(small_batches(spark), sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.chat import format_chats

    chats = format_chats(table(spark, sf_dir, "conversations"))
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return chats.select("conv_id", "n_turns", "text", trained.alias("n_trained_chars"))


def op4_chained_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.substring import find_passages

    return find_passages(table(small_batches(spark), sf_dir, "documents"))


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from quarrymill.llm.packing import pack

    pieces = pack(table(small_batches(spark), sf_dir, "documents"), path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op6_url_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op7_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op8_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.quality import judge

    return judge(table(small_batches(spark), sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.htmltext import extract

    return extract(table(small_batches(spark), sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_target_mix": op1_target_mix,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chat_snapshot_collapse": op3_chat_snapshot_collapse,
    "op4_chained_substring_dedup": op4_chained_substring_dedup,
    "op5_hierarchical_packing": op5_hierarchical_packing,
    "op6_url_redirect_filter": op6_url_redirect_filter,
    "op7_lpt_sharding": op7_lpt_sharding,
    "op8_nra_topk": op8_nra_topk,
    "op9_robust_quality": op9_robust_quality,
    "op10_main_text": op10_main_text,
}

ORACLE_SQL: dict[str, str] = {
    "op1_target_mix": mixing.oracle(),
    "op3_chat_snapshot_collapse": chat.ORACLE,
    "op6_url_redirect_filter": urlfilter.oracle(),
    "op8_nra_topk": topk.ORACLE,
}
