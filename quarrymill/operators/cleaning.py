"""Markdown cleaning that needs to walk lines: one document per row, in Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import text as rules

# Labels of exported requirement attributes, the five that make a block, and verification methods.
ATTRIBUTES = ("Category", "Allocation", "Priority", "Safety", "Verification", "Comment", "No_Out-Links")
CORE = ATTRIBUTES[:5]
METHODS = ("Analysis", "Test", "Inspection", "Demonstration")
# Labels of test-case fields, longest first.
TEST_FIELDS = (
    "Test carried out by", "Verification object", "Test verified by", "Failure criteria", "Test equipment", "Description",
    "Test case", "Test Item", "Reference", "Comment", "Result", "Date", "Test",
)
# Line and identifier patterns.
BRACKETED = re.compile(r"\[[\w_./:|-]+\]")
BRACKETED_LINE = re.compile(r"(?:\[[\w_./:|-]+\]\s*)+")
OBJECT_ID = re.compile(r"(?:#{1,6}\s+)?([A-Z][A-Z0-9]*[-_][\w-]*_\d+)\s*")
NUMBERED_IDS = re.compile(r"(?:\[[\w_./-]*\d+\])+\s*")
TEMPLATE = re.compile(r"#{1,6}\s+PROJECT\s+ACRONYM\s+DOCUMENT\s+TITLE\s*")
HEADING = re.compile(r"#{1,6}\s+")
TEST_START = re.compile(r"^Test case:\s*$", re.M)
TEST_FIELD = re.compile(rf"^(?:##\s+)?({'|'.join(map(re.escape, TEST_FIELDS))})[:\s]*$", re.I | re.M)
NUMBERED_HEADING = re.compile(r"^#{1,3}\s+\d+(?:\.\d+)*\s+", re.M)


def per_document(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function that runs fn on each non-null text, Arrow batches at a time."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else fn(t) for t in texts], dtype=object)

    return run


# -- tables split at page breaks ------------------------------------------------------------------------------------


def _rule_row(line: str) -> bool:
    cells = [c.strip() for c in line.split("|")[1:-1]]
    return line.startswith("|") and bool(cells) and all(set(c) == {"-"} for c in cells if c)


def join_tables(md: str) -> str:
    """Joins pipe tables with only blank lines between and as many columns, without a repeated head."""
    runs: list[tuple[bool, list[str]]] = []  # whether it is a table, its lines
    for line in md.split("\n"):
        table = line.startswith("|")
        if runs and runs[-1][0] == table:
            runs[-1][1].append(line)
        else:
            runs.append((table, [line]))
    out: list[tuple[bool, list[str]]] = []
    for table, lines in reversed(runs):  # from the right, so a joined table joins on
        if table and len(out) > 1 and not out[-1][0] and out[-2][0] and not any(x.strip() for x in out[-1][1]) and lines[0].count("|") == out[-2][1][0].count("|"):
            _, later = out[-2]
            head = 1 if _rule_row(later[0]) else 2 if len(later) > 1 and _rule_row(later[1]) else 0
            out[-2:] = [(True, lines + later[head:])]
        else:
            out.append((table, lines))
    return "\n".join(line for _, lines in reversed(out) for line in lines)


# -- requirement attributes -----------------------------------------------------------------------------------------


@dataclass
class _Attributes:
    """Attributes read so far; label is the one that may still take a value."""

    values: dict[str, str] = field(default_factory=dict)
    traces: list[str] = field(default_factory=list)
    label: str | None = None
    value: str = ""

    def close(self) -> None:
        if self.label:
            self.values[self.label] = self.value.strip()
        self.label, self.value = None, ""

    def open(self, label: str, rest: str) -> None:
        """A label with the rest of its line, where further labels may follow and ids stand."""
        while True:
            inner = next(((name, m) for name in ATTRIBUTES if (m := re.search(rf"\s+{re.escape(name)}:\s*", rest))), None)
            if not inner:
                break
            self.values[label] = rest[: inner[1].start()].strip()
            label, rest = inner[0], rest[inner[1].end() :]
        for trace in BRACKETED.findall(rest):
            rest = rest.replace(trace, "", 1)
            self.traces.append(trace)
        self.label, self.value = label, rest.strip()

    def take(self, line: str) -> bool:
        """Whether a stripped line belongs to the block."""
        if not line or TEMPLATE.fullmatch(line):
            return True
        labelled = re.fullmatch(rf"({'|'.join(map(re.escape, ATTRIBUTES))}):\s*(.*?)\s*", line)
        if labelled:
            self.close()
            self.open(labelled[1], labelled[2])
        elif BRACKETED.match(line):
            self.close()
            self.traces += BRACKETED.findall(line)
        elif self.label and not self.value:
            self.value = line
        elif self.label == "Verification" and line in METHODS:
            self.value += f", {line}"
        elif not (line == "NA" and self.label in (None, "Verification")):
            return False
        return True

    def lines(self) -> list[str] | None:
        """The tag, the ids and an empty line; None if it is no attribute block."""
        held = [f"{n}: {self.values[n]}" for n in CORE if self.values.get(n)]
        if len(held) < 3:
            return None
        held += [f"{n}: {v}" for n in ATTRIBUTES[5:] if (v := self.values.get(n, "").strip()) and v.upper() != "NA"]
        return [f"[{' | '.join(held)}]", *([" ".join(self.traces)] if self.traces else []), ""]


def condense_attributes(md: str) -> str:
    """Replaces each block of requirement attributes (at least three of the core ones) by a tag in brackets."""
    lines, out, i = md.split("\n"), [], 0
    while i < len(lines):
        opened = re.match(r"Category:\s*(.*?)\s*$", lines[i])
        if not opened:
            out.append(lines[i])
            i += 1
            continue
        block, first = _Attributes(label="Category", value=opened[1]), i
        i += 1
        while i < len(lines) and block.take(lines[i].strip()):
            i += 1
        block.close()
        out += block.lines() or lines[first:i]
    return "\n".join(out)


# -- requirement blocks ---------------------------------------------------------------------------------------------


def _is_tag(line: str) -> bool:
    return line.startswith("[Category:") and line.endswith("]")


def _is_trace(line: str) -> bool:
    return bool(BRACKETED_LINE.fullmatch(line))


def _reach_back(bare: list[str], tag: int) -> int:
    """The first line of the requirement that ends in the tag: ids, then text, nothing that is another's."""
    start, ids = tag, False
    for j in range(tag - 1, -1, -1):
        line = bare[j]
        if not line:
            continue
        is_id = bool(OBJECT_ID.fullmatch(line))
        foreign = line.startswith("|") or line == "---" or _is_tag(line) or _is_trace(line) or (HEADING.match(line) and not is_id)
        if foreign or (ids and not is_id):
            break
        ids = ids or is_id
        start = j
    return start


def _reach_on(bare: list[str], tag: int) -> int:
    """The last line of ids after the tag."""
    end = tag
    for j in range(tag + 1, len(bare)):
        line = bare[j]
        if not line:
            continue
        if line.startswith("[Category:") or not _is_trace(line):
            break
        end = j
    return end


def wrap_requirements(md: str) -> str:
    """Sets each requirement (ids, text, tag, traces) between rules, with bold ids and a traceability line."""
    lines = md.split("\n")
    bare = [x.strip() for x in lines]
    out, done = [], 0  # lines before done are written
    for tag in [i for i, x in enumerate(bare) if _is_tag(x)]:
        start, end = max(_reach_back(bare, tag), done), _reach_on(bare, tag)
        if end < done:
            continue
        out += lines[done:start]
        body = start
        names = []
        while body < tag and (not bare[body] or OBJECT_ID.fullmatch(bare[body])):
            names += [OBJECT_ID.fullmatch(bare[body])[1]] if bare[body] else []
            body += 1
        said = lines[body:tag]
        while said and not said[-1].strip():
            said.pop()
        traces = [x for x in bare[tag + 1 : end + 1] if x]
        out += ["", "---", "", *(f"**{n}**" for n in names), *([""] if names else []), *said, *([""] if said else []), bare[tag]]
        out += [f"**Traceability:** {' '.join(traces)}"] if traces else []
        out += ["", "---", ""]
        done = end + 1
    return "\n".join(out + lines[done:])


# -- test cases -----------------------------------------------------------------------------------------------------


def _all_ids(value: str) -> bool:
    lines = [x.strip() for x in value.split("\n") if x.strip()]
    return bool(lines) and all(NUMBERED_IDS.fullmatch(x) for x in lines)


def peel_ids(value: str) -> tuple[str, list[str]]:
    """The value without the id-only lines at its end, and those lines."""
    lines, ids = value.rstrip().split("\n"), []
    while lines and (not lines[-1].strip() or NUMBERED_IDS.fullmatch(lines[-1].strip())):
        last = lines.pop().strip()
        ids = [last, *ids] if last else ids
    return "\n".join(lines).rstrip(), ids


def undisplace(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Gives leading empty fields (two or more) the paragraphs that the first full one swallowed, but for its last."""
    empty = next((i for i, (_, v) in enumerate(pairs) if v.strip()), len(pairs))
    if len(pairs) < 3 or empty < 2 or empty >= len(pairs):
        return pairs
    parts = [p.strip() for p in re.split(r"\n\s*\n", pairs[empty][1].strip()) if p.strip()]
    if len(parts) < 2:
        return pairs
    while parts and (NUMBERED_IDS.fullmatch(parts[0]) or parts[0].startswith("|")):
        parts.pop(0)
    if len(parts) < 2:
        return pairs
    given = min(empty, len(parts) - 1)
    values = [p[3:].strip() if p.startswith("## ") else p for p in parts[:given]]
    fixed = [(pairs[i][0], v) for i, v in enumerate(values)] + pairs[given:]
    fixed[empty] = (pairs[empty][0], "\n\n".join(parts[given:]))
    return fixed


def format_test(block: str) -> str:
    """One test case as bold fields between rules; a block without an id stays as it is."""
    marks = list(TEST_FIELD.finditer(block))
    pairs = []
    for m, end in zip(marks, [*(m.start() for m in marks), len(block)][1:], strict=True):
        value = block[m.end() : end].strip()
        pairs.append((m[1].strip(), value[3:].strip() if value.startswith("## ") else value))
    pairs = undisplace(pairs)
    if not next((v for n, v in pairs if n.lower() == "test case"), ""):
        return block
    last, ids = peel_ids(pairs[-1][1])
    pairs[-1] = (pairs[-1][0], last)
    out = ["---", ""]
    for name, value in pairs:
        if _all_ids(value):
            ids += [x.strip() for x in value.split("\n") if x.strip()]
            continue
        head, _, rest = value.partition("\n")
        head = head.strip()
        if not value:
            continue
        if "\n" in value and (not head or head.startswith(("|", "[VLM"))):
            out += [f"**{name}:**", value.rstrip()]
        else:
            out += [f"**{name}:** {head}", *([rest.rstrip()] if rest.strip() else [])]
    out += [f"**Traceability:** {' '.join(ids)}"] if ids else []
    return "\n".join([*out, "", "---", ""])


def format_tests(md: str) -> str:
    """Every test case, from its start line to the next start or numbered heading."""
    starts = [m.start() for m in TEST_START.finditer(md)]
    out, done = [], 0
    for start, stop in zip(starts, [*starts, len(md)][1:], strict=True):
        out.append(md[done:start])
        line_end = md.find("\n", start, stop) + 1
        cut = NUMBERED_HEADING.search(md, line_end, stop) if line_end else None
        done = cut.start() if cut else stop
        out.append(format_test(md[start:done]))
    return "".join([*out, md[done:]])


# -- columns --------------------------------------------------------------------------------------------------------

unescape_html = per_document(html.unescape)
merge_split_tables = per_document(join_tables)
condense_requirement_attributes = per_document(condense_attributes)
wrap_requirement_blocks = per_document(lambda md: wrap_requirements(md) if "[Category:" in md else md)
restructure_test_cases = per_document(format_tests)
#: The four walks of lines in one pass through Python.
_walks = per_document(lambda md: format_tests(wrap_requirements(condense_attributes(rules_between(join_tables(md))))))


def rules_between(md: str) -> str:
    """The two demotions of headings, which stand between the walks."""
    md = re.sub(rules.FALSE_HEADING, r"\1", md)
    return re.sub(rules.TABLE_CAPTION, r"\1", md)


def clean_markdown(text: Column) -> Column:
    """The whole cleaning in its fixed order: three groups of expressions around two passes through Python."""
    text = rules.strip_banner_tables(rules.strip_timestamps(rules.strip_page_lines(rules.strip_address_block(text))))
    text = rules.strip_copyright(rules.join_hyphenated(rules.strip_template_headings(text)))
    text = _walks(rules.strip_terminal_markers(text))
    text = unescape_html(rules.collapse_rules(rules.clean_results(text)))
    return rules.normalise_blanks(rules.strip_comments(text))
