"""After the model's answer: source manifest, citations, verification, confidence, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The structured response, every field required.
RESPONSE = (
    "answer STRING, claims ARRAY<STRUCT<statement: STRING, source_ids: ARRAY<INT>>>, abstained BOOLEAN, partial BOOLEAN, "
    "unanswered_aspects ARRAY<STRING>, contradictions_noted BOOLEAN, confidence STRING, confidence_reasoning STRING"
)
# Confidence levels in order, and the support that similarity gives.
LEVELS = ("LOW", "MEDIUM", "HIGH")
SUPPORT = ((0.85, 1.0), (0.75, 0.85), (0.65, 0.65))
WEAK = 0.4
HIGH, MEDIUM = 0.75, 0.5
NO_CONTEXT = "The available documents do not hold what is needed to answer this."


def response_schema() -> dict:
    """The JSON schema a model must follow: no field more or less."""
    text, flag, texts = {"type": "string"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}

    def strict(fields: dict) -> dict:
        return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}

    claim = strict({"statement": text, "source_ids": {"type": "array", "items": {"type": "integer"}}})
    body = {
        "answer": text, "claims": {"type": "array", "items": claim}, "abstained": flag, "partial": flag, "unanswered_aspects": texts,
        "contradictions_noted": flag, "confidence": {"type": "string", "enum": list(reversed(LEVELS))}, "confidence_reasoning": text,
    }
    return {"type": "json_schema", "json_schema": {"name": "grounded_answer", "strict": True, "schema": strict(body)}}


def parse_responses(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with the response's fields; ok is false where the reply is no such JSON."""
    return replies.withColumn("_r", F.from_json(reply, RESPONSE)).withColumn("ok", F.col("_r.answer").isNotNull()).select("*", "_r.*").drop("_r")


def source_manifest(sections: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One numbered source for each context section: (query_id, source_id, label, doc_id, doc_type, section_heading,
    section_number, chunk_ids, revision, revision_date, line).

    The label is type and module, section number and heading, as far as they are known.
    sections: query_id, position, doc_id, section_heading, section_number, chunk_ids; meta: doc_id, doc_type, module_name, revision, revision_date.
    """
    full = sections if meta is None else sections.join(meta.select("doc_id", "doc_type", "module_name", "revision", "revision_date"), "doc_id", "left")
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    prefix = F.nullif(F.concat_ws(" ", known("doc_type"), known("module_name")), F.lit(""))
    ref = F.concat(F.lit("§"), known("section_number"))
    heading = F.coalesce(known("section_heading"), F.lit("(untitled section)"))
    label = F.concat_ws(" — ", F.nullif(F.concat_ws(", ", prefix, ref), F.lit("")), heading)
    rev = F.when(known("revision").isNotNull(), F.concat(F.lit("  (Rev "), F.concat_ws(", ", "revision", known("revision_date")), F.lit(")"))).otherwise(F.lit(""))
    sid = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    out = full.select("query_id", sid.alias("source_id"), label.alias("label"), "doc_id", "doc_type", "section_heading", "section_number", "chunk_ids", "revision", "revision_date", rev.alias("_rev"))
    shown = F.array_join(F.transform("chunk_ids", lambda c: F.substring(c.cast("string"), 1, 12)), ", ")
    line = F.concat(F.lit("Source "), F.col("source_id").cast("string"), F.lit(": "), "label", "_rev", F.lit("\n  Chunk IDs: "), shown)
    return out.withColumn("line", line).drop("_rev")


def manifest_text(manifest: DataFrame) -> DataFrame:
    """(query_id, manifest_text)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "line"))), lambda x: x["line"]), "\n\n")
    return manifest.groupBy("query_id").agg(F.concat(F.lit("SOURCE MANIFEST\n\n"), lines).alias("manifest_text"))


def prompts(queries: DataFrame, windows: DataFrame, manifests: DataFrame) -> DataFrame:
    """(query_id, system, user): rules and manifest for the model, context and question."""
    rules = (
        "Answer only from the context. Give every claim the numbers of the sources it rests on. Use no other source numbers. "
        "If the context does not answer, abstain and make no claim. If it answers in part, say which aspects stay open. "
        "Point out sources that contradict each other and prefer the later revision. Quote identifiers and values as they stand. "
        "State how confident you are and why."
    )
    joined = queries.join(windows.select("query_id", "prompt_text"), "query_id", "left").join(manifests, "query_id", "left")
    context = F.coalesce(F.nullif("prompt_text", F.lit("")), F.lit("(no context)"))
    return joined.select("query_id", F.concat_ws("\n\n", F.lit(rules), "manifest_text").alias("system"), F.concat(F.lit("CONTEXT\n\n"), context, F.lit("\n\nQUESTION\n\n"), "query").alias("user"))


def cited(claims: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, source_id): the distinct sources that claims (key, claim_index, source_ids) name."""
    return claims.select(key, F.explode("source_ids").alias("source_id")).distinct()


def resolve_citations(claims: DataFrame, manifest: DataFrame, key: str = "query_id") -> DataFrame:
    """One row for each cited source: label and first chunk from the manifest; mapped is false for numbers that it lacks."""
    joined = cited(claims, key).join(manifest, [key, "source_id"], "left")
    mapped = F.col("label").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    label = F.coalesce("label", F.concat(F.lit("(unmapped source "), F.col("source_id").cast("string"), F.lit(")")))
    return joined.select(key, "source_id", label.alias("label"), F.coalesce(F.try_element_at("chunk_ids", F.lit(1)), F.lit("")).alias("chunk_id"), blank("doc_id"), blank("doc_type"), blank("section_heading"), blank("section_number"), mapped.alias("mapped"))


def verify(responses: DataFrame, claims: DataFrame, valid: DataFrame, key: str = "query_id") -> DataFrame:
    """One row for each response (key, abstained): what its claims (key, claim_index, source_ids) stand on.

    valid: (key, source_id).  A claim with an unknown number still counts as cited.  No claim: coverage 1.
    Unknown numbers come in the order first named, uncited claims by index from zero.
    """
    named = claims.select(key, "claim_index", F.posexplode("source_ids").alias("at", "source_id"))
    wrong = named.join(valid.select(key, "source_id"), [key, "source_id"], "left_anti").groupBy(key, "source_id").agg(F.min(F.struct("claim_index", "at")).alias("place"))
    wrong = wrong.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda x: x["source_id"]).alias("unmapped_source_ids"))
    has = F.size("source_ids") > 0
    per = claims.groupBy(key).agg(F.count("*").alias("n_claims"), F.count_if(has).alias("n_cited"), F.array_sort(F.collect_list(F.when(~has, F.col("claim_index")))).alias("uncited_claim_indices"))
    out = responses.select(key, "abstained").join(per, key, "left").join(wrong, key, "left")
    ints = F.array().cast("array<int>")
    unknown = F.coalesce("unmapped_source_ids", ints)
    n = F.coalesce("n_claims", F.lit(0))
    return out.select(
        key,
        (F.size(unknown) == 0).alias("all_citations_resolved"),
        (F.coalesce("n_cited", F.lit(0)) == n).alias("all_claims_cited"),
        (F.size(unknown) > 0).alias("contains_unmapped_citations"),
        (F.col("abstained") == (n == 0)).alias("abstention_consistent"),
        F.when(n == 0, 1.0).otherwise(F.col("n_cited") / n).alias("citation_coverage_ratio"),
        unknown.alias("unmapped_source_ids"),
        F.coalesce("uncited_claim_indices", ints).alias("uncited_claim_indices"),
    )


def level_rank(level: Column) -> Column:
    """LOW 0, MEDIUM 1, HIGH 2; anything else 0."""
    out = F.lit(0)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def confidence(rows: DataFrame, model: str = "model_confidence", best: str = "best_vector", strategy: str = "strategy") -> DataFrame:
    """rows (with verify()'s columns) with retrieval_support, citation_coverage, verification_pass, system_level, final_level.

    An exact lookup supports itself fully; else the best similarity (none: 0) does.  All components at HIGH or more: HIGH;
    at MEDIUM or more: MEDIUM; else LOW.  The final level is the lower of the model's and the system's.
    """
    similar = F.coalesce(F.col(best), F.lit(0.0))
    support = F.lit(WEAK)
    for at, gives in reversed(SUPPORT):
        support = F.when(similar >= at, gives).otherwise(support)
    passed = F.col("all_citations_resolved") & F.col("abstention_consistent") & ~F.col("contains_unmapped_citations")
    parts = {"retrieval_support": F.when(F.col(strategy) == "exact_lookup", 1.0).otherwise(support), "citation_coverage": F.round("citation_coverage_ratio", 4), "verification_pass": F.when(passed, 1.0).otherwise(0.0)}
    low = F.least(*[F.col(p) for p in parts])
    out = rows.withColumns(parts).withColumn("system_level", F.when(low >= HIGH, "HIGH").when(low >= MEDIUM, "MEDIUM").otherwise("LOW"))
    given = F.when(F.col(model).isin(*LEVELS), F.col(model)).otherwise("LOW")
    return out.withColumn("final_level", F.when(level_rank(F.col("system_level")) <= level_rank(given), F.col("system_level")).otherwise(given))


def abstentions(queries: DataFrame, windows: DataFrame) -> DataFrame:
    """The answer of queries whose context is empty: no model is asked."""
    none = queries.join(windows.where(F.size("chunk_ids") > 0).select("query_id"), "query_id", "left_anti")
    return none.select("query_id", F.lit(NO_CONTEXT).alias("answer"), F.lit(True).alias("abstained"), F.lit("LOW").alias("final_level"), F.lit(0.0).alias("retrieval_support"), F.lit(1.0).alias("citation_coverage"), F.lit(1.0).alias("verification_pass"))
