"""Evaluation of both paths against golden queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import metrics


def evaluate_retrieval(golden: DataFrame, hits: DataFrame, query_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per query, per type and overall).  golden: query_id, query_type, expected_chunk_ids; hits: query_id, chunk_id, rank."""
    asked = golden.where(F.col("query_type") == query_type) if query_type else golden
    relevant = asked.select("query_id", F.explode("expected_chunk_ids").alias("item_id"))
    got = hits.join(asked.select("query_id"), "query_id", "left_semi").select("query_id", F.col("chunk_id").alias("item_id"), "rank")
    per = metrics.retrieval_metrics(asked.select("query_id", "query_type"), got, relevant)
    return per, metrics.stratified(per, "query_type")


def evaluate_generation(golden: DataFrame, rows: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per query, per type and overall).  A query without an answer row counts as an error."""
    docs = citations.where("doc_id <> ''").groupBy("query_id").agg(F.collect_set("doc_id").alias("cited_docs"))
    joined = golden.join(rows.select("query_id", "answer", "abstained", "partial", "final_level", "citation_coverage", "verification_pass", "error"), "query_id", "left").join(docs, "query_id", "left")
    empty = F.array().cast("array<string>")
    joined = joined.withColumns({"cited_docs": F.coalesce("cited_docs", empty), "expected_docs": F.coalesce("expected_doc_ids", empty), "expected_facts": F.coalesce("expected_facts", empty), "answer": F.coalesce("answer", F.lit(""))})
    scored = metrics.flag_scores(metrics.document_scores(metrics.fact_recall(joined)))
    scored = scored.withColumns({"verified": F.coalesce(F.col("verification_pass"), F.lit(0.0)), "error": (F.col("error").isNotNull() | F.col("final_level").isNull()).cast("double")})
    return scored, metrics.stratified(scored, "query_type", metrics.GENERATION)
