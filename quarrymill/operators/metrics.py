"""Evaluation: retrieval metrics per query and stratum, facts, documents, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.answers import level_rank

RETRIEVAL = ("precision", "recall", "reciprocal_rank", "ndcg", "hit")


def retrieval_metrics(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, item: str = "item_id", by: str = "query_id") -> DataFrame:
    """One row for each query: precision, recall, reciprocal rank, nDCG (binary) and hit.

    retrieved: (query_id, item, rank from 1); relevant: (query_id, item).  Nothing retrieved: precision 0.  Nothing
    relevant: recall and nDCG 1.  The ideal order is over as many places as were retrieved.
    by: where what is relevant hangs on another column of queries, relevant has that column in place of query_id, so its
    rows are not repeated for each query.
    """
    good = relevant.select(by, item).distinct().withColumn("rel", F.lit(1))
    placed = retrieved if by == "query_id" else retrieved.join(queries.select("query_id", by), "query_id")
    hits = placed.join(good, [by, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = good.groupBy(by).agg(F.count("*").alias("n_rel"))
    both = queries.join(got, "query_id", "left").join(wanted, by, "left").fillna(0, ["n", "found", "n_rel"])
    ideal = F.aggregate(F.when(F.least("n", "n_rel") > 0, F.sequence(F.lit(1), F.least("n", "n_rel").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1.0)))
    return both.select(
        *queries.columns,
        F.when(F.col("n") > 0, F.col("found") / F.col("n")).otherwise(0.0).alias("precision"),
        F.when(F.col("n_rel") > 0, F.col("found") / F.col("n_rel")).otherwise(1.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("n_rel") == 0, 1.0).when(F.col("n") == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def stratified(rows: DataFrame, stratum: str, names: tuple[str, ...] = RETRIEVAL, overall: str = "overall") -> DataFrame:
    """(stratum, n_queries, means): one row for each stratum and one for all, in one pass."""
    means = [F.avg(F.col(m).cast("double")).alias(m) for m in names]
    out = rows.groupingSets([[F.col(stratum)], []], F.col(stratum)).agg(F.grouping(stratum).alias("_all"), F.count("*").alias("n_queries"), *means)
    return out.withColumn(stratum, F.when(F.col("_all") == 1, F.lit(overall)).otherwise(F.col(stratum))).drop("_all")


def facts_found(answer: Column, facts: Column) -> Column:
    return F.filter(facts, lambda f: F.contains(F.lower(answer), F.lower(f)))


def fact_recall(rows: DataFrame, answer: str = "answer", facts: str = "expected_facts") -> DataFrame:
    """rows with matched, missed and fact_recall; a fact is found as a part of the answer, whatever the case.  None expected: 1."""
    out = rows.withColumn("matched", facts_found(F.col(answer), F.col(facts)))
    out = out.withColumn("missed", F.filter(facts, lambda f: ~F.contains(F.lower(F.col(answer)), F.lower(f))))
    return out.withColumn("fact_recall", F.when(F.size(facts) > 0, F.size("matched") / F.size(facts)).otherwise(1.0))


def document_scores(rows: DataFrame, found: str = "cited_docs", wanted: str = "expected_docs") -> DataFrame:
    """rows with doc_precision (nothing cited: 1) and doc_recall (nothing expected: 1)."""
    common = F.size(F.array_intersect(found, wanted))
    n, m = F.size(F.array_distinct(F.col(found))), F.size(F.array_distinct(F.col(wanted)))
    return rows.withColumn("doc_precision", F.when(n > 0, common / n).otherwise(1.0)).withColumn("doc_recall", F.when(m > 0, common / m).otherwise(1.0))


def at_least(actual: Column, least: Column) -> Column:
    """Whether a confidence level reaches another; unknown levels rank lowest."""
    return level_rank(actual) >= level_rank(least)


def flag_scores(rows: DataFrame) -> DataFrame:
    """rows with abstention_correct, partial_correct and confidence_aligned."""
    return rows.withColumns(
        {
            "abstention_correct": F.col("abstained") == F.col("expected_abstained"),
            "partial_correct": F.col("partial") == F.col("expected_partial"),
            "confidence_aligned": at_least(F.col("final_level"), F.col("min_confidence")),
        }
    )


GENERATION = ("fact_recall", "doc_precision", "doc_recall", "abstention_correct", "partial_correct", "confidence_aligned", "citation_coverage", "verified", "error")


def report(rows: DataFrame, places: int = 4) -> DataFrame:
    """Numbers rounded for printing."""
    return rows.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rows.schema.fields])
