"""What a query asks for: identifiers, scope, remainder, route; and its abbreviations spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Identifier families, in the order in which they are taken out of the query.  The edge of a word is
# spelled out where accented letters matter.
TEST_CASE = r"(?i)\b(FVT[SR]?_[A-Z]+_\d+)\b"
REQUIREMENT = r"(?i)\b(HW-IRS_[\p{L}\p{N}_]+)\b"
COMPONENT = r"(?i)\b(7HA[\s-]\d{5}[\s-][A-Z]{4})\b"
CROSS_BRACKET = r"\[([A-Z][A-Z0-9_:]+(?::[A-Z0-9_]+)+)\]"
CROSS_BARE = r"\b([A-Z]{2,}(?::[A-Z0-9_]+){1,})\b"
# Scope words and what they stand for.
DOC_TYPES = {"FVTR": "FVTR", "HWIRS": "HwIRS", "HW-IRS": "HwIRS"}
DOC_TYPE = r"(?i)\b(FVTR|HwIRS|HW-IRS|HWIRS)\b"
MODULES = {"DIM-V": "DIM-V", "DIM-VI": "DIM-V", "DIM-NV": "DIM-NV", "DIM": "DIM", "PAM": "PAM"}
MODULE = r"(?i)\b(DIM-(?:V|VI|NV)|DIM|PAM)\b"
SYSTEM = r"(?i)\b(TOP)\b"
# Words that carry no meaning of their own.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "of", "in", "to", "for", "with", "on", "at", "from", "by",
    "about", "as", "into", "through", "during", "before", "after", "and", "but", "or", "nor", "not", "no", "so", "yet",
    "what", "which", "who", "whom", "where", "when", "how", "why", "this", "that", "these", "those", "it", "its",
    "all", "each", "every", "both", "few", "more", "most", "some", "any", "other", "such",
    "me", "my", "i", "you", "your", "we", "our", "they", "their", "show", "get", "find", "give", "list", "tell",
    "?", "!", ".", ",", ":", ";",
)
ACRONYM = r"\b([A-Z][A-Z0-9]{1,}(?:-[A-Z]{1,3})?)\b"
ABBREVIATION_ROW = r"(?m)^\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|"


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _blank(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, " ")


def _blank_first(text: Column, pattern: str) -> Column:
    """Blanks the first match alone."""
    return F.regexp_replace(text, f"(?si)^(.*?){pattern.removeprefix('(?i)')}", "$1 ")


def _canonical(token: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for raw, name in names.items():
        out = F.when(F.upper(token) == raw, name).otherwise(out)
    return F.when(token != "", out)


def identifiers(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """queries with test_case_ids, requirement_ids, component_ids, cross_references and rest, the text without them."""
    q = F.col(text_col)
    out = queries.withColumns(
        {
            "test_case_ids": _all(q, TEST_CASE),
            "requirement_ids": _all(q, REQUIREMENT),
            "component_ids": F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(COMPONENT), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit("-")))),
            "_bracket": _all(q, CROSS_BRACKET),
            "_rest": _blank(_blank(_blank(_blank(q, TEST_CASE), REQUIREMENT), COMPONENT), CROSS_BRACKET),
        }
    )
    out = out.withColumn("cross_references", F.array_distinct(F.concat("_bracket", _all(F.col("_rest"), CROSS_BARE)))).withColumn("rest", _blank(F.col("_rest"), CROSS_BARE))
    return out.drop("_bracket", "_rest")


def analyse(queries: DataFrame, text_col: str = "query", keep_ids_in_text: bool = False) -> DataFrame:
    """queries with their identifiers, scope (doc_type, module_name: null without), scoped, remainder, strategy, search_text.

    The first document-type word and the first module word scope the search; a system word does so only without either, and
    sets no filter.  Identifiers and no meaningful word: exact_lookup.  Identifiers or scope: scoped_semantic.  Else
    unconstrained.  search_text is the remainder, or the query if nothing remains; keep_ids_in_text takes the query always.
    """
    out = identifiers(queries, text_col)
    doc_type = F.regexp_extract("rest", DOC_TYPE, 1)
    out = out.withColumn("doc_type", _canonical(doc_type, DOC_TYPES)).withColumn("rest", F.when(doc_type != "", _blank_first(F.col("rest"), DOC_TYPE)).otherwise(F.col("rest")))
    module = F.regexp_extract("rest", MODULE, 1)
    out = out.withColumn("module_name", _canonical(module, MODULES)).withColumn("rest", F.when(module != "", _blank_first(F.col("rest"), MODULE)).otherwise(F.col("rest")))
    system = F.col("doc_type").isNull() & F.col("module_name").isNull() & F.col("rest").rlike(SYSTEM)
    out = out.withColumn("_system", system).withColumn("rest", F.when(F.col("_system"), _blank_first(F.col("rest"), SYSTEM)).otherwise(F.col("rest")))
    words = F.filter(F.split(F.lower(F.trim(F.regexp_replace("rest", r"\s+", " "))), " "), lambda w: w != "")
    meaning = F.size(F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))) > 0
    has_ids = F.size("test_case_ids") + F.size("requirement_ids") + F.size("component_ids") + F.size("cross_references") > 0
    scoped = F.col("doc_type").isNotNull() | F.col("module_name").isNotNull() | F.col("_system")
    remainder = F.trim(F.regexp_replace("rest", r"\s+", " "))
    out = out.withColumns(
        {
            "has_identifiers": has_ids,
            "scoped": scoped,
            "remainder": remainder,
            "strategy": F.when(has_ids & ~meaning, "exact_lookup").when(has_ids | scoped, "scoped_semantic").otherwise("unconstrained"),
        }
    )
    text = F.col(text_col) if keep_ids_in_text else F.when(F.col("remainder") != "", F.col("remainder")).otherwise(F.col(text_col))
    return out.withColumn("search_text", text).drop("rest", "_system")


def abbreviations(chunks: DataFrame, doc_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """(doc_id, acronym, expansion) of abbreviation tables: the first two cells of a row, blanks joined, the acronym in
    capitals, the last of equal ones in a document.  order: columns that place a document's chunks."""
    listed = chunks.select(doc_col, F.struct(*(order or [text_col])).alias("at"), F.posexplode(F.filter(F.split(text_col, "\n"), lambda x: x.rlike(ABBREVIATION_ROW))).alias("row", "line"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cells = listed.select(doc_col, "at", "row", squeeze(F.regexp_extract("line", ABBREVIATION_ROW, 1)).alias("short"), squeeze(F.regexp_extract("line", ABBREVIATION_ROW, 2)).alias("expansion"))
    rule = r"^[\s|:-]+$"
    real = cells.where((F.lower("short") != "abbreviation") & (F.lower("expansion") != "meaning") & ~F.col("short").rlike(rule) & ~F.col("expansion").rlike(rule) & (F.col("short") != "") & (F.col("expansion") != ""))
    placed = real.withColumn("acronym", F.upper("short"))
    return placed.groupBy(doc_col, "acronym").agg(F.max_by("expansion", F.struct("at", "row")).alias("expansion"), F.min(F.struct("at", "row")).alias("first"))


def expansions(table: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(acronym, expansion, ord): distinct expansions over all documents, in document order from 1."""
    once = table.groupBy("acronym", "expansion").agg(F.min(doc_col).alias("d"))
    return once.select("acronym", "expansion", F.row_number().over(Window.partitionBy("acronym").orderBy("d", "expansion")).alias("ord"))


def meaning_of(table: DataFrame, doc_id=None, doc_col: str = "doc_id") -> DataFrame:
    """(acronym, expansion): one document's, or each acronym's first."""
    return table.where(F.col(doc_col) == doc_id).select("acronym", "expansion") if doc_id is not None else expansions(table, doc_col).where("ord = 1").select("acronym", "expansion")


def acronyms(text: Column) -> Column:
    """Capitalised candidates, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(1)))


def expand(queries: DataFrame, table: DataFrame, query_id: str = "query_id", text_col: str = "query", scope_col: str | None = None, doc_col: str = "doc_id") -> DataFrame:
    """queries with expanded: the text and, after it, each distinct expansion of its acronyms in order.

    With scope_col (a document's id) that document's own expansion is taken where it has one; else all there are.
    """
    asked = queries.select(query_id, *([F.col(scope_col).alias("scope")] if scope_col else [F.lit(None).cast(table.schema[doc_col].dataType).alias("scope")]), F.posexplode(acronyms(F.col(text_col))).alias("at", "acronym"))
    own = asked.join(table.select(F.col(doc_col).alias("scope"), "acronym", "expansion"), ["scope", "acronym"]).select(query_id, "at", "acronym", F.lit(1).alias("ord"), "expansion")
    rest = asked.join(own, [query_id, "acronym"], "left_anti").join(expansions(table, doc_col), "acronym").select(query_id, "at", "acronym", "ord", "expansion")
    every = own.union(rest).groupBy(query_id, "expansion").agg(F.min(F.struct("at", "ord")).alias("place"))
    listed = every.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "expansion"))), lambda x: x["expansion"]), " ").alias("tail"))
    return queries.join(listed, query_id, "left").withColumn("expanded", F.concat_ws(" ", text_col, "tail")).drop("tail")
