"""What comes from outside: converter, embedder, reranking model, chat model.  Each has an offline stand-in."""

from __future__ import annotations

import hashlib
import html
import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    size: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashed words, brought to length one: close texts are near, and no model is needed."""

    def __init__(self, size: int = 256) -> None:
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9_-]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


class LexicalPairScorer:
    """Share of the query's words that the text has: a stand-in for a cross-encoder's raw score."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(re.findall(r"[a-z0-9_-]+", t.lower()))
        return [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs]


class ExtractiveModel:
    """A stand-in for a chat model: quotes each source's first sentence as a claim, abstains without context."""

    def __call__(self, system: str, user: str) -> str:
        context = user.partition("\n\nQUESTION\n\n")[0].removeprefix("CONTEXT\n\n")
        parts = [p for p in context.split("### ")[1:] if p.strip()]
        claims = [{"statement": re.split(r"(?<=\.)\s", p.partition("\n\n")[2].strip() or p)[0], "source_ids": [i]} for i, p in enumerate(parts, 1)]
        return json.dumps({
            "answer": " ".join(f"{c['statement']} [Source {c['source_ids'][0]}]" for c in claims), "claims": claims, "abstained": not claims, "partial": False,
            "unanswered_aspects": [], "contradictions_noted": False, "confidence": "MEDIUM" if claims else "LOW", "confidence_reasoning": "quoted",
        })


def with_retries(call: Callable, tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Calls again after a failure, waiting twice as long each time; the last failure is raised."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:
                if n == tries - 1:
                    raise
                sleep(wait * 2**n)
        return None

    return run


def embed(rows: DataFrame, text_col: str, embedder: Embedder, batch: int = 20, out: str = "embedding") -> DataFrame:
    """rows with a vector for each text, in batches, with retries; a vector of another size is an error."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = with_retries(embedder)
        for texts in series:
            found: list = []
            listed = texts.fillna("").tolist()
            for i in range(0, len(listed), batch):
                got = call(listed[i : i + batch])
                if any(len(v) != embedder.size for v in got):
                    raise ValueError(f"expected vectors of size {embedder.size}")
                found += got
            yield pd.Series(found)

    return rows.withColumn(out, run(F.col(text_col)))


def pair_scores(rows: DataFrame, query_col: str, text_col: str, scorer: Callable[[list[tuple[str, str]]], list[float]], out: str = "raw") -> DataFrame:
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(queries.fillna(""), texts.fillna(""), strict=True))), dtype=float)

    return rows.withColumn(out, run(F.col(query_col), F.col(text_col)))


def complete(prompts: DataFrame, model: Callable[[str, str], str], tries: int = 5) -> DataFrame:
    """prompts (query_id, system, user) with reply and error; an empty reply or one that is no JSON is tried again."""

    def checked(system: str, user: str) -> str:
        reply = model(system, user)
        json.loads(reply)
        return reply

    @F.pandas_udf("reply string, error string")
    def run(systems: pd.Series, users: pd.Series) -> pd.DataFrame:
        call = with_retries(checked, tries)
        out = []
        for s, u in zip(systems, users, strict=True):
            try:
                out.append((call(s, u), None))
            except Exception as e:  # one query's failure is its own
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["reply", "error"])

    return prompts.withColumn("_c", run("system", "user")).select(*prompts.columns, "_c.reply", "_c.error")


# -- conversion -----------------------------------------------------------------------------------------------------

# Headings and pictures that carry nothing.
STUB_HEADINGS = (
    "contents", "table of contents", "list of tables", "list of figures", "list of abbreviations", "list of acronyms", "list of appendices",
    "list of annexes", "list of references", "list of documents", "list of drawings", "list of diagrams", "list of illustrations", "list of symbols",
)
PLACEHOLDER = "[Figure — see source document]"
VAGUE = r"(?i)\b(unclear|unreadable|illegible|cannot|can't|unable|no (?:visible|discernible))\b"


def filter_elements(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, text, ..) of a converted document without what repeats on pages.

    Drops page headers and footers, indexes, banners and stub headings, tables with an identity cell, and logos; a
    picture becomes its description or a placeholder.  Columns: kind, text, picture_class, description.
    """
    low = F.lower(F.trim("text"))
    heading = (F.col("kind") == "heading") & (low.isin(*STUB_HEADINGS) | F.col("text").rlike(r"(?i)^\s*\w+\s+group\s+\w+\s*$"))
    identity = (F.col("kind") == "table") & F.col("text").rlike(r"(?i)\|\s*(?:entity|doc(?:ument)?[ ._-]?(?:id|no|number))\b")
    logo = (F.col("kind") == "picture") & (F.coalesce("picture_class", F.lit("")) == "logo")
    kept = elements.where(~(F.col("kind").isin("page_header", "page_footer", "document_index") | heading | identity | logo))
    return kept.withColumn("text", F.when(F.col("kind") == "picture", F.coalesce(F.nullif("description", F.lit("")), F.lit(PLACEHOLDER))).otherwise(F.col("text")))


def figure_tag(number, caption, described):
    """The tag of a described picture; a description that says it sees nothing is none."""
    label = F.concat_ws(": ", F.concat_ws(" ", F.lit("Figure"), F.nullif(number, F.lit(""))), F.nullif(caption, F.lit("")))
    return F.when((F.length(F.trim(described)) >= 20) & ~described.rlike(VAGUE), F.concat(F.lit("[VLM - "), label, F.lit("] "), F.trim(described)))


TAGS = re.compile(r"<!--.*?-->|<(script|style|nav|footer|head)\b.*?</\1\s*>|<(/?)(h[1-6]|p|li|br|tr|td|th|ul|ol|table|div|article|section)\b[^>]*>|<[^>]*>", re.S | re.I)


def html_to_markdown(page: str) -> str:
    """Headings, paragraphs, lists and tables of a page: the offline converter."""
    out: list[str] = []
    at = 0

    def mark(m: re.Match) -> str:
        end, name = m[2], (m[3] or "").lower()
        if name.startswith("h") and not end:
            return f"\n\n{'#' * int(name[1])} "
        if name == "li" and not end:
            return "\n- "
        if name in ("td", "th"):
            return " " if end else "| "
        if name == "tr":
            return "|" if end else "\n"
        return "\n\n" if name and name != "br" else "\n" if name == "br" else ""

    for m in TAGS.finditer(page):
        out += [re.sub(r"\s+", " ", page[at : m.start()]), mark(m)]
        at = m.end()
    out.append(re.sub(r"\s+", " ", page[at:]))
    lines = [x.strip() for x in html.unescape("".join(out)).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_to_markdown(content: bytes) -> str:
    """Headings, paragraphs, list items and tables of a DOCX file, whose main part is XML in a zip archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD_NS}body")
    said = lambda node: "".join("\t" if t.tag == f"{WORD_NS}tab" else t.text or "" for t in node.iter() if t.tag in (f"{WORD_NS}t", f"{WORD_NS}tab"))
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD_NS}p":
            text = said(node).strip()
            style = node.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
            name = (style.get(f"{WORD_NS}val") or "").lower() if style is not None else ""
            level = re.fullmatch(r"heading\s*([1-6])", name)
            listed = node.find(f"{WORD_NS}pPr/{WORD_NS}numPr") is not None
            if text:
                out.append("#" * int(level[1]) + " " + text if level else "# " + text if name == "title" else "- " + text if listed else text)
        elif node.tag == f"{WORD_NS}tbl":
            rows = [[re.sub(r"\s+", " ", " ".join(said(p) for p in cell.iter(f"{WORD_NS}p"))).strip().replace("|", "\\|") for cell in row.findall(f"{WORD_NS}tc")] for row in node.findall(f"{WORD_NS}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows if r]
            if lines:
                lines.insert(1, "|" + "---|" * len(rows[0]))
                out.append("\n".join(lines))
    return "\n\n".join(out)


def file_to_markdown(content: bytes, path: str) -> str:
    """By the file's ending; what no converter here can read is an error, not a guess."""
    kind = path.rpartition(".")[2].lower()
    if kind == "docx":
        return docx_to_markdown(content)
    if kind in ("html", "htm"):
        return html_to_markdown(content.decode("utf-8", "replace"))
    raise ValueError(f"no converter for .{kind} files is installed")


def convert_files(files: DataFrame, converter: Callable[[bytes, str], str] = file_to_markdown) -> DataFrame:
    """As convert(), for a converter that takes a file's bytes and path."""

    @F.pandas_udf("markdown string, error string")
    def run(contents: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for content, path in zip(contents, paths, strict=True):
            try:
                out.append((converter(bytes(content), path), None))
            except Exception as e:  # one document's failure is its own
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["markdown", "error"])

    done = files.withColumn("_m", run("content", "path")).select(*files.columns, "_m.markdown", "_m.error")
    return _titled(done)


def _titled(done: DataFrame) -> DataFrame:
    heading = F.nullif(F.regexp_extract("markdown", r"(?m)^#{1,6}\s+(.+)$", 1), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1) if "path" in done.columns else F.lit("")
    return done.withColumn("title", F.coalesce(F.trim(heading), stem))


def convert(files: DataFrame, converter: Callable[[str], str] = html_to_markdown, content: str = "content") -> DataFrame:
    """files with markdown, title (first heading, else the file's name) and error; a file that fails has an error alone."""

    @F.pandas_udf("markdown string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            out = []
            for p in pages:
                try:
                    out.append((converter(p.decode("utf-8", "replace") if isinstance(p, bytes) else p or ""), None))
                except Exception as e:  # one document's failure is its own
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["markdown", "error"])

    done = files.withColumn("_m", run(F.col(content))).select(*files.columns, "_m.markdown", "_m.error")
    return _titled(done)
