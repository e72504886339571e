"""Reciprocal rank fusion of two ranked lists, and the late join of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(vector_hits: DataFrame, bm25_hits: DataFrame, keys: list[str], n: int = 20, k: int = 60, query_id: str = "query_id") -> DataFrame:
    """(query_id, keys, score, vector_score, bm25_score, vec_rank, bm25_rank, rank): sums of 1/(k + rank) over both lists.

    Inputs have (query_id, keys, rank, score).  A chunk of one list alone has 0 as its other score.  Ties: the vector
    list's order first, then the lexical list's.
    """
    on = [query_id, *keys]
    v = vector_hits.select(*on, F.col("rank").alias("vec_rank"), F.col("score").alias("vector_score"))
    b = bm25_hits.select(*on, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = v.join(b, on, "full_outer").withColumn("score", part("vec_rank") + part("bm25_rank"))
    both = both.fillna(0.0, ["vector_score", "bm25_score"])
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), *keys)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def backfill(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Texts and metadata for the hits alone: joined after the cut, so no text travels for chunks that lose."""
    return hits.join(chunks, keys, "left")
