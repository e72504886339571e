"""Reranking: raw scores of a provider, brought to a scale per query, and the first k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW = 800


def first_k(hits: DataFrame, score: Column, k: int, query_id: str = "query_id", ties: tuple[str, ...] = ("rank",)) -> DataFrame:
    """The k best of each query by score, ties in the order they came."""
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round(score, 9)), *ties)
    return hits.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def min_max(hits: DataFrame, k: int = 8, raw: str = "raw", query_id: str = "query_id", ties: tuple[str, ...] = ("rank",)) -> DataFrame:
    """Raw scores spread over 0 to 1 within each query (all equal: 0) become rerank_score and score."""
    w = Window.partitionBy(query_id)
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    scaled = hits.withColumn("rerank_score", F.when(high > low, (F.col(raw) - low) / (high - low)).otherwise(F.lit(0.0))).withColumn("score", F.col("rerank_score"))
    return first_k(scaled, F.col("rerank_score"), k, query_id, ties)


def clamped(hits: DataFrame, k: int = 8, raw: str = "raw", query_id: str = "query_id", ties: tuple[str, ...] = ("rank",)) -> DataFrame:
    """Judged scores of 0 to 10, held to that range and divided by ten; a missing one is 0."""
    held = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(F.col(raw).cast("double"), F.lit(0.0)))) / 10
    return first_k(hits.withColumn("rerank_score", held).withColumn("score", held), F.col("rerank_score"), k, query_id, ties)


def judged_scores(replies: DataFrame, query_id: str = "query_id", reply: str = "reply") -> DataFrame:
    """(query_id, index, raw) of replies that hold a JSON array of index and score; others give nothing."""
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(body, "array<struct<index:int,score:double>>")
    return replies.select(query_id, F.explode(parsed).alias("s")).select(query_id, F.col("s.index").alias("index"), F.col("s.score").alias("raw")).where("index IS NOT NULL")


def unchanged(hits: DataFrame, k: int = 8, rank: str = "rank") -> DataFrame:
    return hits.where(F.col(rank) <= k)


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


RERANKERS: dict[str, Callable] = {"cross-encoder": min_max, "llm": clamped, "none": unchanged}


def reranker(name: str) -> Callable:
    """By name, whatever its case and blanks; an unknown one is an error."""
    key = name.strip().lower().replace("_", "-")
    if key not in RERANKERS:
        raise ValueError(f"unknown reranker {name!r}; known: {', '.join(sorted(RERANKERS))}")
    return RERANKERS[key]
