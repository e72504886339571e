"""Three tiers of chunks: document, section, atomic.  Structure by windows, sizes by folds over a section's blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import fields
from quarrymill.operators import structure
from quarrymill.session import written

PROSE_LIKE = ("prose", "list")
TABLES = ("table", "definition_table", "abbreviation_table")
FRONT = "Front Matter"
RULE_ROW = re.compile(r"\|[\s\-:|]+\|")

# Words that tell document types, modules and systems.
REPORT_WORDS = r"(?i)verification\s+test\s+report|FVTR"
SPEC_WORDS = r"(?i)requirements?\s+specification|HwIRS|HWIRS"
MODULE_PARENS = r"\(([A-Z][A-Z0-9-]+)\)"
MODULE_DASH = r"(?i)(?:module|board)\s*[-–—]\s*(?:vital\s*)?\(?([A-Z][A-Z0-9-]+)"
NO_MODULES = ("TOP", "FVTR", "HWIRS", "TAS")
KNOWN_MODULES = ("DIM-V", "DIM", "PAM", "DOM", "AOM", "COM")
EVOLUTIONS = r"(?i)follow-up|evolutions"


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 400
    min_tokens: int = 50
    max_tokens: int = 800
    split_threshold: int = 1000
    overlap_tokens: int = 50


def estimate_tokens(text: str) -> int:
    """A token for every four characters; blank texts have none.  The default counter, as it needs no vocabulary file."""
    return len(text) // 4 if text.strip() else 0


def token_count(text: Column) -> Column:
    return F.when(text.rlike(r"\S"), F.floor(F.length(text) / 4)).otherwise(F.lit(0)).cast("int")


def chunk_id(doc_id: Column, path: list[Column], block: Column, sub: Column) -> Column:
    """SHA-256 of document, path, block and piece, joined by bars."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), *path, block.cast("string"), sub.cast("string")), 256)


# -- folds ----------------------------------------------------------------------------------------------------------


def merge_small(items: list[tuple], count: Callable[[str], int], config: ChunkConfig) -> list[tuple]:
    """Joins prose and lists of under min_tokens with a neighbour of their section.

    items: (section, type, text).  A small one takes the next with it if that is prose or list too; else it joins the
    one before; else it stays.  The first of the two gives the type.
    """
    out: list[tuple] = []
    waiting = list(reversed(items))
    while waiting:
        node, kind, text = waiting.pop()
        small = kind in PROSE_LIKE and count(text) < config.min_tokens
        if small and waiting and waiting[-1][0] == node and waiting[-1][1] in PROSE_LIKE:
            out.append((node, kind, f"{text.strip()}\n\n{waiting.pop()[2].strip()}"))
        elif small and out and out[-1][0] == node and out[-1][1] in PROSE_LIKE:
            out[-1] = (*out[-1][:2], f"{out[-1][2].strip()}\n\n{text.strip()}")
        else:
            out.append((node, kind, text))
    return out


def overlap_of(last: str, count: Callable[[str], int], limit: int) -> str:
    """What the next piece repeats of the last part: all of it, or a share of its end."""
    if limit <= 0:
        return ""
    tokens = count(last)
    return last if tokens <= limit else last[-max(1, int(len(last) * (limit / max(tokens, 1)))) :]


def pack_segments(segments: list[str], count: Callable[[str], int], config: ChunkConfig) -> list[str]:
    """Greedy pieces of at most max_tokens, each after the first led by an overlap; parts are joined by empty lines.

    A segment over the limit is packed line by line.
    """
    parts: list[str] = []
    for segment in filter(None, map(str.strip, segments)):
        long = count(segment) > config.max_tokens and "\n" in segment
        parts += filter(None, map(str.strip, segment.split("\n"))) if long else [segment]
    pieces: list[list[str]] = []
    held = 0
    for part in parts:
        size = count(part)
        if pieces and held + size <= config.max_tokens:
            pieces[-1].append(part)
            held += size
            continue
        lead = overlap_of(pieces[-1][-1], count, config.overlap_tokens) if pieces else ""
        pieces.append([lead, part] if lead else [part])
        held = size + (count(lead) if lead else 0)
    return ["\n\n".join(p) for p in pieces] or (["\n\n".join(segments)] if segments else [])


def split_table(text: str, count: Callable[[str], int], config: ChunkConfig) -> list[str]:
    """Row-wise pieces of at most max_tokens, each with the head (up to the rule row); without one, packed paragraphs."""
    lines = text.strip().split("\n")
    rule = next((i for i, x in enumerate(lines) if RULE_ROW.fullmatch(x.strip())), None)
    if rule is None:
        return pack_segments(re.split(r"\n\n+", text.strip()), count, config)
    head = "\n".join(lines[: rule + 1])
    pieces: list[list[str]] = []
    held = base = count(head)
    for row in lines[rule + 1 :]:
        size = count(row)
        if not pieces or held + size > config.max_tokens:
            pieces.append([])
            held = base
        pieces[-1].append(row)
        held += size
    return ["\n".join([head, *p]) for p in pieces] or [text]


def pieces_of(kind: str, text: str, count: Callable[[str], int], config: ChunkConfig) -> list[str]:
    """The pieces of one block: prose and lists over max_tokens and others over split_threshold are cut."""
    limit = config.max_tokens if kind in PROSE_LIKE else config.split_threshold
    if count(text) <= limit:
        return [text]
    if kind in TABLES:
        return split_table(text, count, config)
    parts = re.split(r"\n\n+", text.strip())
    if len(parts) == 1:
        parts = re.split(r"(?<=\.)\s+(?=[A-Z])", text.strip()) if kind in PROSE_LIKE else text.strip().split("\n")
    return pack_segments(parts, count, config)


def size_fold(count: Callable[[str], int] = estimate_tokens, config: ChunkConfig = ChunkConfig(), merge: bool = True) -> Callable[[Column], Column]:
    """A column function: a section's blocks in order, array<struct<node, kind, text>>, to its pieces
    (emit, sub, node, kind, text, whole, tokens)."""

    @F.pandas_udf("array<struct<emit:int,sub:int,node:int,kind:string,text:string,whole:string,tokens:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            for items in series:
                listed = [(b["node"], b["kind"], b["text"]) for b in items]
                listed = merge_small(listed, count, config) if merge else listed
                out.append([
                    {"emit": e, "sub": s, "node": node, "kind": kind, "text": piece, "whole": text, "tokens": count(piece)}
                    for e, (node, kind, text) in enumerate(listed)
                    for s, piece in enumerate(pieces_of(kind, text, count, config))
                ])
            yield pd.Series(out, dtype=object)

    return run


# -- document metadata ----------------------------------------------------------------------------------------------


def _pick(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(values, test), F.lit(1))


def _approval_cells(text: Column) -> Column:
    """The cells of the first run of table rows from the line that opens an approval table, among the first 80 lines."""
    rows = F.transform(F.slice(F.split(text, "\n"), 1, 80), lambda x: F.struct(x.alias("line"), x.rlike(structure.TABLE_ROW).alias("row"), (F.lower(x).rlike("approval|written by|approved by") & x.rlike(structure.TABLE_ROW)).alias("opens")))
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.when((acc["state"] == 2) | ((acc["state"] == 0) & ~x["opens"]), acc)
        .when(~x["row"], F.struct(F.lit(2).alias("state"), acc["kept"].alias("kept")))
        .otherwise(F.struct(F.lit(1).alias("state"), F.array_append(acc["kept"], x["line"]).alias("kept"))),
        lambda acc: acc["kept"],
    )
    return F.transform(walked, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))


def document_meta(sections: DataFrame, blocks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """One row for each document: title, type, module, system, revision, authors, approvers.

    From the first five top-level headings: the first that names a report or a specification is the title, else the
    first heading.  The module is the first bracketed or dashed abbreviation that isn't a system's or type's, of a heading
    not about changes; else of the title; else a known name.  The revision is the last row of the change log; without
    a date there, the latest date of the approval table.  Names come from approval rows among the first 80 lines.
    """
    top = sections.where("parent = 0").groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "heading"))), lambda x: x["heading"]).alias("all_heads"))
    heads = F.slice("all_heads", 1, 5)
    typed = _pick(F.col("heads"), lambda h: h.rlike(REPORT_WORDS) | h.rlike(SPEC_WORDS))
    meta = docs.select(id_col, _approval_cells(F.col(text_col)).alias("cells")).join(top, id_col, "left").select(id_col, "cells", F.coalesce(heads, F.array().cast("array<string>")).alias("heads"))
    meta = meta.withColumn("named", typed)

    def abbreviation(h: Column) -> Column:
        parens = F.regexp_extract(h, MODULE_PARENS, 1)
        dash = F.regexp_extract(h, MODULE_DASH, 1)
        fits = lambda m: (m != "") & ~F.upper(m).isin(*NO_MODULES)
        return F.when(fits(parens), F.struct(parens.alias("name"), F.regexp_replace(F.regexp_extract(h, r"(?s)^\s*(.*?)\([A-Z][A-Z0-9-]+\)", 1), r"[\s\-–—]+$", "").alias("full"))).when(
            fits(dash), F.struct(dash.alias("name"), F.lit("").alias("full"))
        )

    def inner(h: Column) -> Column:
        """Of a type heading, any bracketed abbreviation that fits."""
        every = F.filter(F.regexp_extract_all(h, F.lit(MODULE_PARENS), F.lit(1)), lambda m: ~F.upper(m).isin(*NO_MODULES))
        return F.struct(F.try_element_at(every, F.lit(1)).alias("name"), F.lit("").alias("full"))

    outer = F.try_element_at(F.filter(F.transform(F.filter("heads", lambda h: ~h.rlike(r"(?i)follow-up|introduction|evolutions")), abbreviation), lambda m: m.isNotNull()), F.lit(1))
    within = F.try_element_at(F.filter(F.transform(F.filter("heads", lambda h: h.rlike(REPORT_WORDS) | h.rlike(SPEC_WORDS)), inner), lambda m: m["name"].isNotNull()), F.lit(1))
    joined = F.array_join("heads", " ")
    known = F.lit(None).cast("string")
    for name in reversed(KNOWN_MODULES):
        known = F.when(F.contains(joined, F.lit(name)), name).otherwise(known)
    meta = meta.withColumn("module", F.coalesce(outer, within))

    change = sections.where(F.col("parent") == 0).where(F.col("heading").rlike(EVOLUTIONS)).groupBy(id_col).agg(F.min("line").alias("node"))
    tables = blocks.where("block_type = 'table'").join(change, [id_col, "node"])
    upper = F.upper("text")
    log = tables.where(F.contains(upper, F.lit("LOG OF CHANGES")) | F.contains(upper, F.lit("REVISION"))).groupBy(id_col).agg(F.min_by("text", "start_line").alias("log"))
    last = F.try_element_at(fields.table_rows(F.col("log")), F.lit(-1))
    log = log.select(id_col, F.when(F.size(last) > 1, last).alias("row"))
    approval = tables.where(F.contains(upper, F.lit("APPROVAL"))).groupBy(id_col).agg(F.min_by("text", "start_line").alias("approval"))
    dates = F.transform(F.flatten(fields.table_rows(F.col("approval"))), lambda c: F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0))
    approval = approval.select(id_col, F.nullif(F.array_max(dates), F.lit("")).alias("approved_on"))
    meta = meta.join(log, id_col, "left").join(approval, id_col, "left")

    def person(label: str, unless: str | None = None) -> Column:
        hits = F.filter("cells", lambda c: (F.size(c) > 1) & F.contains(F.lower(c[0]), F.lit(label)) & (F.try_element_at(c, F.lit(2)) != "") & (~F.contains(F.lower(c[0]), F.lit(unless)) if unless else F.lit(True)))
        name = F.try_element_at(F.try_element_at(hits, F.lit(-1)), F.lit(2))
        return F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))

    blank = lambda c: F.coalesce(c, F.lit(""))
    named = F.col("named")
    return meta.select(
        id_col,
        blank(F.coalesce(named, F.try_element_at("heads", F.lit(1)))).alias("doc_title"),
        F.when(named.rlike(REPORT_WORDS), "FVTR").when(named.rlike(SPEC_WORDS), "HwIRS").otherwise("").alias("doc_type"),
        blank(F.coalesce(F.col("module.name"), known)).alias("module_name"),
        blank(F.col("module.full")).alias("module_full_name"),
        F.when(F.contains(joined, F.lit("TOP")), "TOP").otherwise("").alias("system"),
        blank(F.trim(F.col("row")[0])).alias("revision"),
        blank(F.coalesce(F.nullif(F.trim(F.col("row")[1]), F.lit("")), F.col("approved_on"))).alias("revision_date"),
        person("written by").alias("authors"),
        person("approved by", "written by").alias("approvers"),
    )


def document_summary() -> Column:
    """The text of a document's tier-1 chunk from its metadata."""
    c = lambda name: F.nullif(F.col(name), F.lit(""))
    return F.concat_ws(
        "\n",
        c("doc_title"),
        F.when(c("module_full_name").isNotNull(), F.concat(F.lit("Module: "), c("module_full_name"), F.lit(" ("), "module_name", F.lit(")"))).otherwise(F.concat(F.lit("Module: "), c("module_name"))),
        F.concat(F.lit("Document type: "), c("doc_type")),
        F.concat(F.lit("System: "), c("system")),
        F.concat(F.lit("Revision: "), c("revision"), F.lit(" ("), F.col("revision_date"), F.lit(")")),
        F.when(F.size("authors") > 0, F.concat(F.lit("Authors: "), F.array_join("authors", ", "))),
    )


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before white space, if that is within 300 characters; else of the first line 300 characters."""
    lead = F.regexp_extract(text, r"(?s)^(.*?\.)\s", 1)
    return F.when((lead != "") & (F.length(lead) <= 300), lead).otherwise(F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, 300))


# -- chunks ---------------------------------------------------------------------------------------------------------

FIELD_TYPES = {
    "test_case": ("test_case_id", "test_name", "test_item", "test_result", "date", "tester", "verifier", "failure_criteria", "traceability_ids", "reference_ids"),
    "requirement": ("requirement_ids", "category", "allocation", "priority", "safety", "verification_method", "is_background", "traceability_ids"),
}


def block_fields(text: Column, whole: Column, kind: Column) -> list[Column]:
    """Metadata of a piece; what a piece of a cut block lacks comes from the whole block."""
    out: dict[str, Column] = {"cross_references": fields.cross_references(text), "component_ids": fields.component_ids(text), "has_table": fields.has_table(text), "has_figure": fields.has_figure(text)}
    made = {"test_case": fields.test_case_fields, "requirement": fields.requirement_fields}
    typed: dict[str, Column] = {}
    for name, make in made.items():
        own, full = make(text), make(whole)
        for key in FIELD_TYPES[name]:
            if key.endswith("_ids"):
                value = F.when(F.size(own[key]) > 0, own[key]).otherwise(full[key])
            elif key == "is_background":
                value = own[key] | full[key]
            else:
                value = F.coalesce(own[key], full[key])
            typed[key] = F.when(kind == name, value) if key not in typed else F.when(kind == name, value).otherwise(typed[key])
    for key, value in typed.items():
        if key.endswith("_ids"):
            typed[key] = F.coalesce(value, F.array().cast("array<string>"))
        elif key == "is_background":
            typed[key] = F.coalesce(value, F.lit(False))
    return [c.alias(k) for k, c in (out | typed).items()]


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), count: Callable[[str], int] = estimate_tokens, id_col: str = "doc_id", text_col: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """(chunks, document metadata).

    chunks: chunk_id, doc_id, chunk_type, tier, text, token_count, parent_id, ord (place in the parent), section_path,
    section_number, heading and the fields of block_fields().  Top-level sections before the first numbered one, and
    text before the first heading, are one front-matter section whose blocks are not classified and of which only the
    sections' own blocks and their direct children's count.  The ids of a document's children are those with it as
    parent, in the order of ord.
    """
    docs = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("markdown"))
    lined = structure.lines(docs)
    sections = written(structure.sections(lined.where("level IS NOT NULL")), "chunk-sections")  # a heading's place hangs on headings alone
    in_order = Window.partitionBy("doc_id").orderBy("line")
    tops = sections.where("parent = 0").withColumn("numbered", F.max(F.col("section_number").isNotNull().cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    tops = tops.withColumn("sec_idx", F.sum("numbered").over(in_order) - 1)
    top = tops.select("doc_id", F.col("line").alias("root"), F.col("heading").alias("top_heading"), F.col("section_number").alias("top_number"), "numbered", "sec_idx")
    # all steps to the blocks go by document, so that lines are shuffled once; headings come as one row for each document
    nodes = sections.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("line").alias("node"), F.col("heading").alias("node_heading"), F.col("section_number").alias("node_number"), F.col("parent").alias("node_parent"))).alias("nodes"))
    roots = top.groupBy("doc_id").agg(F.collect_list(F.struct("root", "top_heading", "top_number", "numbered", "sec_idx")).alias("roots"))
    blocks = structure.blocks(structure.islands(structure.regions(structure.sections(lined))))
    own = _pick(F.col("nodes"), lambda n: n["node"] == F.col("node"))
    above = _pick(F.col("roots"), lambda n: n["root"] == F.col("root"))
    at = blocks.join(nodes, "doc_id", "left").join(roots, "doc_id", "left").select(*blocks.columns, own.alias("own"), above.alias("above"))
    at = written(at.select(*blocks.columns, "own.node_heading", "own.node_number", "own.node_parent", "above.top_heading", "above.numbered", "above.sec_idx"), "chunk-blocks")
    meta = written(document_meta(sections, at, docs), "chunk-meta")

    doc_key = chunk_id(F.col("doc_id"), [F.lit("__document__")], F.lit(0), F.lit(0))
    tier1 = meta.select(doc_key.alias("chunk_id"), "doc_id", F.lit("document_meta").alias("chunk_type"), F.lit(1).alias("tier"), document_summary().alias("text"), F.lit(0).alias("ord"))

    # sections of the body
    lead = at.where((F.col("numbered") == 1) & F.col("block_type").isin("prose", "atomic_delimited")).groupBy("doc_id", "node").agg(F.min_by("text", "start_line").alias("lead"))
    body = top.where("numbered = 1")
    kids = sections.where("parent > 0").select("doc_id", F.col("line").alias("node"), F.col("heading").alias("kid"), F.col("parent").alias("root")).join(lead, ["doc_id", "node"], "left")
    kid_text = F.concat_ws("\n\n", F.concat(F.lit("### "), "kid"), F.nullif(first_sentence(F.col("lead")), F.lit("")))
    kids = kids.groupBy("doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("node", kid_text.alias("t")))).alias("kids"))
    paras = lead.select("doc_id", F.col("node").alias("root"), F.nullif(structure.stripped(F.substring_index("lead", "\n\n", 1)), F.lit("")).alias("para"))
    body = body.join(paras, ["doc_id", "root"], "left").join(kids, ["doc_id", "root"], "left")
    sec_key = chunk_id(F.col("doc_id"), [F.lit("__section__"), F.col("top_heading")], F.col("sec_idx"), F.lit(0))
    told = F.concat_ws("\n\n", F.concat(F.lit("## "), "top_heading"), "para", F.array_join(F.transform("kids", lambda k: k["t"]), "\n\n"))
    body = body.select(sec_key.alias("chunk_id"), "doc_id", told.alias("text"), F.col("sec_idx").cast("int"), "root", F.col("top_heading").alias("heading"), F.col("top_number").alias("section_number"))

    # leaves of the body
    kind = fields.classify_block(F.col("block_type"), F.col("text"), F.col("node_heading"))
    listed = at.where("numbered = 1").select("doc_id", "root", "start_line", F.col("node").cast("int").alias("node"), kind.alias("kind"), "text", "node_heading", "node_number", "top_heading", "sec_idx")
    heads = F.collect_set(F.struct(F.col("node").cast("int").alias("node"), "node_heading", "node_number")).alias("nodes")
    head = _pick(F.col("nodes"), lambda n: n["node"] == F.col("node"))
    folded = listed.groupBy("doc_id", "root", "top_heading", "sec_idx").agg(F.array_sort(F.collect_list(F.struct("start_line", "node", "kind", "text"))).alias("items"), heads)
    plain = F.transform("items", lambda b: F.struct(b["node"].alias("node"), b["kind"].alias("kind"), b["text"].alias("text")))
    leaf = folded.select("doc_id", "top_heading", "sec_idx", "nodes", F.posexplode(size_fold(count, config)(plain)).alias("ord", "p")).select("doc_id", "top_heading", "sec_idx", "nodes", "ord", "p.*")
    leaf = leaf.withColumn("head", head).select("*", "head.node_heading", "head.node_number", sec_key.alias("parent_id"))
    path = F.when(F.col("node_heading") == F.col("top_heading"), F.array("top_heading")).otherwise(F.array("top_heading", "node_heading"))
    leaf_key = chunk_id(F.col("doc_id"), [F.concat(F.lit("__s"), F.col("sec_idx").cast("string"), F.lit("__")), F.array_join(path, "|")], F.col("emit"), F.col("sub"))
    leaves = leaf.select(leaf_key.alias("chunk_id"), "doc_id", F.col("kind").alias("chunk_type"), "text", "whole", F.col("tokens").alias("token_count"), "parent_id", "ord", path.alias("section_path"), F.col("node_number").alias("section_number"), F.col("node_heading").alias("heading"))

    # front matter
    fronts = at.where("root = 0 or numbered = 0").where("node = root or node_parent = root")
    front_heads = top.where("numbered = 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("root", "top_heading"))).alias("heads"))
    front_items = fronts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_line", F.col("node").cast("int").alias("node"), F.lit("front_matter").alias("kind"), "text"))).alias("items"), heads)
    front_key = chunk_id(F.col("doc_id"), [F.lit("__section__"), F.lit(FRONT)], F.lit(0), F.lit(0))
    front_text = F.concat_ws("\n", F.lit(f"## {FRONT}"), F.array_join(F.transform("heads", lambda h: F.concat(F.lit("- "), h["top_heading"])), "\n"))
    front = front_items.join(front_heads, "doc_id", "left")
    front_sec = front.select(front_key.alias("chunk_id"), "doc_id", F.regexp_replace(front_text, r"\n$", "").alias("text"), F.lit(-1).alias("sec_idx"), F.lit(0).alias("root"), F.lit(FRONT).alias("heading"), F.lit(None).cast("string").alias("section_number"))
    front_leaf = front.select("doc_id", "nodes", F.posexplode(size_fold(count, config, merge=False)(plain)).alias("ord", "p")).select("doc_id", "nodes", "ord", "p.*").select("*", head["node_heading"].alias("node_heading"))
    front_leaves = front_leaf.select(
        chunk_id(F.col("doc_id"), [F.lit(FRONT)], F.col("emit"), F.col("sub")).alias("chunk_id"), "doc_id", F.lit("front_matter").alias("chunk_type"), "text", "whole", F.col("tokens").alias("token_count"),
        front_key.alias("parent_id"), "ord", F.array(F.lit(FRONT)).alias("section_path"), F.lit(None).cast("string").alias("section_number"), F.coalesce("node_heading", F.lit(FRONT)).alias("heading"),
    )

    counted = F.udf(count, "int") if count is not estimate_tokens else token_count
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_idx")) - 1
    secs = body.drop("root").unionByName(front_sec.drop("root")).select("chunk_id", "doc_id", F.lit("section").alias("chunk_type"), F.lit(2).alias("tier"), "text", doc_key.alias("parent_id"), place.alias("ord"), F.array("heading").alias("section_path"), "section_number", "heading")
    upper = tier1.unionByName(secs, allowMissingColumns=True).withColumn("token_count", counted(F.col("text"))).withColumn("whole", F.col("text"))
    chunks = upper.unionByName(leaves.unionByName(front_leaves).withColumn("tier", F.lit(3)), allowMissingColumns=True)
    empty = F.array().cast("array<string>")
    fields_of = [F.when(F.col("tier") == 3, c).otherwise(F.when(F.lit(True), empty) if n.endswith("_ids") or n == "cross_references" else F.lit(False) if n in ("has_table", "has_figure", "is_background") else F.lit(None)).alias(n) for n, c in zip(FIELD_NAMES, block_fields(F.col("text"), F.col("whole"), F.col("chunk_type")), strict=True)]
    return chunks.select("chunk_id", "doc_id", "chunk_type", "tier", "text", "token_count", "parent_id", "ord", F.coalesce("section_path", empty).alias("section_path"), "section_number", "heading", *fields_of), meta


FIELD_NAMES = ["cross_references", "component_ids", "has_table", "has_figure", *dict.fromkeys([*FIELD_TYPES["test_case"], *FIELD_TYPES["requirement"]])]


def children_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, children_ids): the ids of each parent's children in order."""
    kids = chunks.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("children_ids"))
    return kids.withColumnRenamed("parent_id", "chunk_id")


def of_tier(chunks: DataFrame, tier: int) -> DataFrame:
    return chunks.where(F.col("tier") == tier)
