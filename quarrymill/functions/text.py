"""Markdown cleaning as column expressions (JVM-side regular expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a layout model takes for headings.
FALSE_HEADINGS = (
    "passed", "failed", "not applicable", "n/a", "yes", "no", "open", "closed", "verified", "not verified", "accepted",
    "rejected", "pending", "cancelled", "deferred", "waived", "completed", "incomplete", "ok", "nok", "tbd", "tbc",
)
# Lines that carry nothing.
PAGE_LINE = r"(?im)^\s*page\s+\d+\s+of\s+\d+\s*$"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?"
LONE_TIMESTAMP = rf"(?im)^\s*(?:\d{{1,2}}\s+{MONTH}|{MONTH}|\d{{4}})\s*$"
TEMPLATE_HEADING = r"(?m)^#{1,6}\s+PROJECT\s+ACRONYM\s+DOCUMENT\s+TITLE\s*$"
TERMINAL_MARKER = r"(?im)^(?:#{1,6}\s+)?(?:END\s+OF\s+DOCUMENT|\((?:Start|End)\s+Of\s+Doors\s+Export\))\s*$"
#: The issuer's name in banners and copyright lines is any word.
COPYRIGHT_LINE = "(?m)^This document is not to be reproduced.*?©\\s*\\w+\\s+\\d{4}\\s*-\\s*All\\s+rights\\s+reserved\\.\\s*$"
BANNER_TABLE = r"(?im)^#{1,6}\s+\w+\s+GROUP\s+\w+\s*\n(?:\s*\n)*\|.+\|\s*\n\|[-| ]+\|\s*\n(?:\|.+\|\s*\n)*"
ADDRESS_BLOCK = r"(?i)\A\s*(?:#{1,6}\s+.+\n)?(?:.*\n){0,5}?(?=.*(?:Tel\.|Fax\.|www\.))(?:.*\n)*?(?:.*www\.\S+.*\n)"
HYPHEN_BREAK = r"([a-z])- ([a-z])"
TABLE_CAPTION = r"(?m)^#{1,6}\s+(Table\s+\d+\s*:.*)$"
RESULT_NOISE = r"(?im)^(\*\*Result:\*\*\s+).+(passed|failed|not applicable)\s*$"
RULES_RUN = r"(?m)(?:^[ \t]*[-=_]{3,}[ \t]*$\s*){2,}"
FALSE_HEADING = r"(?im)^##\s+(" + "|".join(FALSE_HEADINGS) + r")\s*$"
COMMENT = r"(?s)<!--.*?-->"


def _drop(pattern: str):
    return lambda text: F.regexp_replace(text, pattern, "")


strip_address_block = _drop(ADDRESS_BLOCK)
strip_page_lines = _drop(PAGE_LINE)
strip_timestamps = _drop(LONE_TIMESTAMP)
strip_banner_tables = _drop(BANNER_TABLE)
strip_template_headings = _drop(TEMPLATE_HEADING)
strip_copyright = _drop(COPYRIGHT_LINE)
strip_terminal_markers = _drop(TERMINAL_MARKER)
strip_comments = _drop(COMMENT)


def join_hyphenated(text: Column) -> Column:
    """daugh- ter becomes daughter; only between lower-case letters."""
    return F.regexp_replace(text, HYPHEN_BREAK, "$1$2")


def demote_false_headings(text: Column) -> Column:
    return F.regexp_replace(text, FALSE_HEADING, "$1")


def demote_table_captions(text: Column) -> Column:
    return F.regexp_replace(text, TABLE_CAPTION, "$1")


def clean_results(text: Column) -> Column:
    """Of a result field only passed, failed or not applicable stays."""
    return F.regexp_replace(text, RESULT_NOISE, "$1$2")


def collapse_rules(text: Column) -> Column:
    return F.regexp_replace(text, RULES_RUN, "---\n")


def normalise_blanks(text: Column) -> Column:
    """No blanks at line ends, at most one empty line in a row, none around the whole."""
    ends = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(ends, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def heading_level(heading: Column) -> Column:
    """Of a numbered heading, the count of its number's parts; null for others."""
    number = F.regexp_extract(F.trim(heading), r"^(\d+(?:\.\d+)*)\b", 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).cast("int")


def basic_unescape(text: Column) -> Column:
    """The five named references of XML and the no-break space; unescape_html() in operators.cleaning knows all."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out
