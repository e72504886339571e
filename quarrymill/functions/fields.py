"""Fields of text blocks as column expressions: classification, identifiers, table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of bold fields.
BOLD_FIELDS = {
    "test_case_id": "Test case",
    "test_name": "Test",
    "test_item": "Test Item",
    "test_result": "Result",
    "date": "Date",
    "tester": "Test carried out by",
    "verifier": "Test verified by",
    "failure_criteria": "Failure criteria",
}
# Fields of a condensed attribute tag.
TAG_FIELDS = {"category": r"\[Category:", "allocation": "Allocation:", "priority": "Priority:", "safety": "Safety:", "verification_method": "Verification:"}
# Identifier patterns.  Word characters are spelled out, as \w knows only ASCII in the JVM.
WORD_CHAR = r"[\p{L}\p{N}_]"
BRACKET_ID = r"\[([A-Z][A-Z0-9_:]+(?::[A-Z0-9_]+)*)\]"
REQUIREMENT_ID = rf"HW-IRS_{WORD_CHAR}+"
REFERENCE_ID = rf"HW-\s*IRS_{WORD_CHAR}+|[A-Z][A-Z0-9_]{{2,}}"
COMPONENT_ID = r"7HA[\s-]\d{5}[\s-][A-Z]{4}"
REFERENCE_BLOCK = r"(?i)\*\*Reference:\*\*\s*([\s\S]*?)(?=\n\*\*|\z)"
TRACE_LINE = r"(?i)\*\*Traceability:\*\*\s*.+?(?:\n|$)"
FIGURE = r"(?im)\[VLM\s*-|\[Figure\s*[—–-]|^Figure\s+\d+:"
TABLE_ROW = r"(?m)^\|.*\|"
# Capitalised words that are no reference.
GENERIC_WORDS = (
    "CMCS", "HWCC", "HEM", "ECN", "RoHS", "WEEE", "ESD", "RAM", "LED", "FAST", "BOM", "DII", "DIM", "PAM", "TOP",
    "NOT", "THE", "AND", "FOR", "ALL", "TEST", "NONE", "STANDARD", "ANALYSIS", "INSPECTION", "DEMONSTRATION",
    "NA", "TBD", "TBC", "YES", "NO_OUT", "LINKS",
)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, trimmed; null if there is none or it is blank."""
    value = F.trim(F.regexp_extract(text, pattern, group))
    return F.when(value != "", value)


def all_found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bold_field(text: Column, label: str) -> Column:
    """The rest of the line after **label:**, whatever its case."""
    return found(text, rf"(?i)\*\*{label}:\*\*\s*(.+?)(?:\n|$)")


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def cross_references(text: Column) -> Column:
    return sorted_set(all_found(text, BRACKET_ID, 1))


def component_ids(text: Column) -> Column:
    return sorted_set(F.transform(all_found(text, COMPONENT_ID), lambda x: F.replace(x, F.lit(" "), F.lit("-"))))


def requirement_ids(text: Column) -> Column:
    return sorted_set(all_found(text, REQUIREMENT_ID))


def traceability_ids(text: Column) -> Column:
    """Bracketed ids of the first traceability line, in order, repeats kept."""
    return all_found(F.regexp_extract(text, TRACE_LINE, 0), BRACKET_ID, 1)


def reference_ids(text: Column) -> Column:
    """Ids of the reference block: bracketed ones, then loose ones, each once, without generic words."""
    block = F.regexp_extract(text, REFERENCE_BLOCK, 1)
    loose = F.transform(all_found(block, REFERENCE_ID), lambda x: F.regexp_replace(x, r"^HW-\s+IRS_", "HW-IRS_"))
    return F.filter(F.array_distinct(F.concat(all_found(block, BRACKET_ID, 1), loose)), lambda x: ~F.upper(x).isin(*GENERIC_WORDS))


def test_case_fields(text: Column) -> dict[str, Column]:
    return {name: bold_field(text, label) for name, label in BOLD_FIELDS.items()} | {"traceability_ids": traceability_ids(text), "reference_ids": reference_ids(text)}


def requirement_fields(text: Column) -> dict[str, Column]:
    tags = {name: found(text, rf"{label}\s*([^|\]]+)") for name, label in TAG_FIELDS.items()}
    return {"requirement_ids": requirement_ids(text), **tags, "is_background": F.coalesce(F.lower(tags["category"]) == "background", F.lit(False)), "traceability_ids": traceability_ids(text)}


def has_table(text: Column) -> Column:
    return text.rlike(TABLE_ROW)


def has_figure(text: Column) -> Column:
    return text.rlike(FIGURE)


def classify_block(block_type: Column, text: Column, heading: Column) -> Column:
    """The chunk type of a block, by its shape, its text and (tables) its section's heading."""
    atomic = (
        F.when(text.rlike(r"(?i)\*\*Test\s+case:\*\*"), "test_case")
        .when(text.rlike(rf"(?i)HW-IRS_{WORD_CHAR}+") | text.rlike(r"(?i)\[Category:\s*\w+\s*\|"), "requirement")
        .otherwise("prose")
    )
    table = F.when(heading.rlike(r"(?i)\bdefinitions?\b"), "definition_table").when(heading.rlike(r"(?i)\babbreviations?\b"), "abbreviation_table").otherwise("table")
    return F.when(block_type == "atomic_delimited", atomic).when(block_type == "table", table).when(block_type.isin("list", "figure"), block_type).otherwise("prose")


def table_rows(text: Column) -> Column:
    """Cells of a pipe table's rows, without the separator row and, of several rows, the first."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    rows = F.filter(lines, lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s\-:|]+\|$"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    return F.when(F.size(cells) > 1, F.slice(cells, 2, F.size(cells))).otherwise(cells)
