"""Text and metadata that go with a chunk's vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Readable names of chunk types.
TYPE_LABELS = {
    "document_meta": "Document Meta", "front_matter": "Front Matter", "section": "Section", "test_case": "Test Case",
    "requirement": "Requirement", "table": "Table", "definition_table": "Definition Table",
    "abbreviation_table": "Abbreviation Table", "prose": "Prose", "figure": "Figure", "list": "List",
}


def full(col: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(""))


def type_label(kind: Column) -> Column:
    out = kind
    for name, label in TYPE_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def summary_line(kind: str = "chunk_type") -> Column:
    """What a test case or a requirement is, in one line; null for others and where nothing is known."""
    test = F.concat_ws(" — ", F.when(full("test_case_id").isNotNull(), F.concat_ws(": ", full("test_case_id"), full("test_name"))), labelled("Result: ", full("test_result")))
    need = F.concat_ws(
        " — ",
        F.when(F.size("requirement_ids") > 0, F.array_join("requirement_ids", ", ")),
        full(F.concat_ws(", ", labelled("Safety: ", full("safety")), labelled("Verification: ", full("verification_method")))),
    )
    return full(F.when(F.col(kind) == "test_case", test).when(F.col(kind) == "requirement", need))


def enriched_text(kind: str = "chunk_type", text: str = "text") -> Column:
    """[document type | module | chunk type | heading], the summary line, a rule, the text.

    Columns: doc_type, module_name, chunk_type, heading, section_path, text and the fields of summary_line().  A chunk
    without a heading takes the last of its section path.
    """
    heading = F.coalesce(full("heading"), full(F.try_element_at("section_path", F.lit(-1))))
    head = F.concat_ws(" | ", full("doc_type"), full("module_name"), full(type_label(F.col(kind))), heading)
    lead = F.concat_ws("\n", F.when(head != "", F.concat(F.lit("["), head, F.lit("]"))), summary_line(kind))
    return F.when(lead != "", F.concat(lead, F.lit("\n---\n"), F.col(text))).otherwise(F.col(text))


def with_enriched(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    joined = chunks.join(meta.select("doc_id", "doc_type", "module_name"), "doc_id", "left")
    return joined.withColumn("enriched", enriched_text())


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """One flat row for each chunk: empty values null, flags only where true, id lists joined by semicolons."""
    flag = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    joined = lambda c: full(F.array_join(c, ";")).alias(c)
    return chunks.select(
        "chunk_id",
        *[full(c).alias(c) for c in ("doc_id", "doc_type", "module_name", "chunk_type", "section_number", "heading")],
        flag("has_table"),
        flag("has_figure"),
        F.when(F.col("token_count") > 0, F.col("token_count")).alias("token_count"),
        full("test_case_id").alias("test_case_id"),
        full("test_result").alias("test_result"),
        joined("requirement_ids"),
        joined("traceability_ids"),
    )
