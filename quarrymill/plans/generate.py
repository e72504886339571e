"""Answers for a batch of queries: prompt, model, citations, verification, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import answers
from quarrymill.plans.corpus import Corpus
from quarrymill.plans.retrieve import Retrieval
from quarrymill.session import written
from quarrymill.sources.providers import ExtractiveModel, complete


def generate(queries: DataFrame, found: Retrieval, corpus: Corpus, model: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, citations).  Queries without context abstain without a call; a failed call is an error of its row.

    answers: query_id, answer, abstained, partial, claims, model_confidence, final_level, the confidence's components,
    verification, strategy, error.
    """
    listed = found.sections.withColumn("chunk_ids", F.transform("children", lambda c: c["chunk_id"]))
    manifest = written(answers.source_manifest(listed, corpus.meta), "manifest")
    asked = queries.join(manifest.select("query_id").distinct(), "query_id", "left_semi")
    prompts = answers.prompts(asked, found.windows, answers.manifest_text(manifest))
    replies = written(answers.parse_responses(complete(prompts, model or ExtractiveModel())), "replies")  # asks the model once
    claims = replies.where("ok").select("query_id", F.posexplode("claims").alias("claim_index", "c")).select("query_id", "claim_index", F.col("c.statement").alias("statement"), F.coalesce("c.source_ids", F.array().cast("array<int>")).alias("source_ids"))
    citations = answers.resolve_citations(claims, manifest)
    checked = answers.verify(replies.where("ok"), claims, manifest)
    best = found.hits.groupBy("query_id").agg(F.max("vector_score").alias("best_vector"))
    rated = checked.join(best, "query_id", "left").join(found.analysis.select("query_id", "strategy"), "query_id").join(replies.select("query_id", F.col("confidence").alias("model_confidence")), "query_id")
    rated = answers.confidence(rated)
    told = replies.select("query_id", "answer", "abstained", "partial", "claims", "unanswered_aspects", "error").join(rated, "query_id", "left")
    silent = answers.abstentions(queries, found.windows).withColumn("partial", F.lit(False))
    return told.unionByName(silent, allowMissingColumns=True), citations


def render(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, text): answer, sources and confidence for reading."""
    listed = citations.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "label"))), lambda c: F.concat(F.lit("  ["), c["source_id"].cast("string"), F.lit("] "), c["label"])), "\n").alias("sources"))
    joined = rows.join(listed, "query_id", "left")
    return joined.select("query_id", F.concat_ws("\n\n", F.coalesce("answer", F.concat(F.lit("Error: "), "error")), F.concat(F.lit("Sources:\n"), "sources"), F.concat(F.lit("Confidence: "), "final_level")).alias("text"))
