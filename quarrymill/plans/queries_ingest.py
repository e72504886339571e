"""Queries over the ingest operators: identity, registry, store rows, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as rules
from quarrymill.operators import cleaning, lexical, vectors
from quarrymill.plans.catalogue import query, table
from quarrymill.sources import registry, selection
from quarrymill.sources.providers import convert

HASHED = "SELECT *, sha256(text) AS hash FROM documents"
LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def hashed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("hash", registry.content_hash(F.col("text")))


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def content_hash(spark, sf_dir):
    return hashed(spark, sf_dir).select("doc_id", "hash", F.octet_length("text").cast("long").alias("size_bytes"))


@query(f"SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM ({HASHED}) GROUP BY hash HAVING count(*) > 1")
def exact_dedup(spark, sf_dir):
    return hashed(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""
WITH h AS ({HASHED}), r AS (SELECT hash, source || '-' || (doc_id % 40) AS filename FROM h WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN hash IN (SELECT hash FROM r) THEN 'UNCHANGED' WHEN source || '-' || (doc_id % 40) IN (SELECT filename FROM r) THEN 'MODIFIED' ELSE 'NEW' END AS status
FROM h""")
def registry_status(spark, sf_dir):
    files = hashed(spark, sf_dir).select("doc_id", "hash", F.concat_ws("-", "source", (F.col("doc_id") % 40).cast("string")).alias("filename"))
    return registry.status(files, files.where("doc_id % 3 = 0")).select("doc_id", "status")


@query(f"""
WITH h AS (SELECT DISTINCT hash, substr(hash, 1, 2) AS filename, doc_id FROM ({HASHED})),
r AS (SELECT DISTINCT hash, filename FROM h WHERE doc_id % 2 = 0), a AS (SELECT DISTINCT hash, filename FROM h WHERE doc_id % 7 = 0)
SELECT hash, filename FROM r WHERE hash NOT IN (SELECT hash FROM a) AND filename NOT IN (SELECT filename FROM a) UNION ALL SELECT hash, filename FROM a""")
def registry_upsert(spark, sf_dir):
    files = hashed(spark, sf_dir).select("doc_id", "hash", F.substring("hash", 1, 2).alias("filename"))
    cols = ["hash", "filename"]
    return registry.upsert(files.where("doc_id % 2 = 0").select(*cols).distinct(), files.where("doc_id % 7 = 0").select(*cols))


@query(f"""
WITH h AS (SELECT DISTINCT hash, substr(hash, 1, 2) AS filename, doc_id FROM ({HASHED})),
r AS (SELECT DISTINCT hash, filename FROM h WHERE doc_id % 2 = 0), a AS (SELECT DISTINCT hash, filename FROM h WHERE doc_id % 7 = 0)
SELECT DISTINCT r.hash, r.filename FROM r JOIN a USING (filename) WHERE r.hash <> a.hash""")
def registry_superseded(spark, sf_dir):
    files = hashed(spark, sf_dir).select("doc_id", "hash", F.substring("hash", 1, 2).alias("filename"))
    cols = ["hash", "filename"]
    return registry.superseded(files.where("doc_id % 2 = 0").select(*cols).distinct(), files.where("doc_id % 7 = 0").select(*cols))


@query(f"SELECT DISTINCT hash FROM ({HASHED}) WHERE doc_id % 4 = 1 AND hash IN (SELECT hash FROM ({HASHED}) WHERE doc_id % 3 = 0)")
def registry_membership(spark, sf_dir):
    docs = hashed(spark, sf_dir)
    return registry.known(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 4 = 1").select("hash").distinct())


@query(f"""
WITH h AS (SELECT *, source || '-' || (doc_id % 40) AS filename FROM ({HASHED})), r AS (SELECT * FROM h WHERE doc_id % 3 = 0)
SELECT CASE WHEN doc_id % 11 = 0 THEN 'unsupported' WHEN doc_id % 13 = 0 THEN 'failed' WHEN hash IN (SELECT hash FROM r) THEN 'unchanged'
  WHEN filename IN (SELECT filename FROM r) THEN 're-ingested' ELSE 'new' END AS outcome, count(*) AS n_files
FROM h GROUP BY 1""")
def ingest_summary(spark, sf_dir):
    files = hashed(spark, sf_dir).select("doc_id", "hash", F.concat_ws("-", "source", (F.col("doc_id") % 40).cast("string")).alias("filename"))
    return registry.summary(files, files.where("doc_id % 3 = 0"), F.col("doc_id") % 11 != 0, F.col("doc_id") % 13 == 0)


PATH = "regexp_replace(url, '[?#].*$', '')"


@query(f"SELECT DISTINCT {PATH} AS path FROM pages WHERE lower(regexp_extract({PATH}, '(\\.[^./]*)$', 1)) IN ('.html', '.htm')")
def supported_filter(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return selection.supported_files(paths, kinds=(".html", ".htm"))


@query("SELECT DISTINCT url AS path FROM pages WHERE (contains(url, '/en/') OR page_id % 10 = 0) AND NOT contains(url, '.net/')")
def manifest_except(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    has = lambda part: F.contains("path", F.lit(part))
    return selection.manifest_rows(pages.where("page_id % 10 = 0"), pages.where(has("/en/")), pages.where(has(".net/")))


def line_chunks(spark, sf_dir) -> DataFrame:
    lines = lexical.lines_as_chunks(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", "text", F.lit(3).alias("tier"), F.concat_ws(":", "doc_id", "ord").alias("chunk_id"))


@query(f"WITH l AS ({LINES}) SELECT doc_id || ':' || ord AS chunk_id FROM l WHERE (doc_id + ord) % 5 <> 0")
def incremental_embed(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    return vectors.to_embed(chunks, chunks.where("(doc_id + ord) % 5 = 0")).select("chunk_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def vector_delete_by_doc(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    kept, _ = vectors.delete_documents(store, table(spark, sf_dir, "documents").where("source = 'src0'"))
    return kept.select(F.col("doc_id").alias("vec_id"), "label")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def existing_ids(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return vectors.existing(store, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 4 = 0")
def vector_upsert(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return vectors.upsert(store, store.where("id % 4 = 0").withColumn("label", F.lit(-1)))


# Documents in the dress of a converted file: what cleaning has to take off.
NOISE_SQL = """(SELECT doc_id, 'Page ' || (doc_id % 30) || ' of 30' || chr(10) || '## ' || CASE WHEN doc_id % 2 = 0 THEN 'Passed' ELSE source END || chr(10) || '12 Sep 2014 11:28' || chr(10)
  || replace(text, ' the ', ' th- e ') || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || '### Table ' || (doc_id % 9) || ': lang ' || lang || chr(10) || '**Result:** A. Tester passed' || chr(10)
  || '---' || chr(10) || '-----' || chr(10) || '<!-- note ' || chr(10) || doc_id || ' -->' || '## END OF DOCUMENT' || chr(9) || chr(10) || '# END OF DOCUMENT' || chr(10) AS md FROM documents)"""


def noisy(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = lambda m: (F.col("doc_id") % m).cast("string")
    md = F.concat(
        F.lit("Page "), n(30), F.lit(" of 30\n## "), F.when(F.col("doc_id") % 2 == 0, "Passed").otherwise(F.col("source")), F.lit("\n12 Sep 2014 11:28\n"), F.replace("text", F.lit(" the "), F.lit(" th- e ")),
        F.lit("  \n\n\n\n### Table "), n(9), F.lit(": lang "), "lang", F.lit("\n**Result:** A. Tester passed\n---\n-----\n<!-- note \n"), F.col("doc_id").cast("string"), F.lit(" -->## END OF DOCUMENT\t\n# END OF DOCUMENT\n"),
    )
    return d.select("doc_id", md.alias("md"))


def _clean(name: str, fn, sql: str) -> None:
    @query(f"SELECT doc_id, {sql} AS cleaned FROM {NOISE_SQL}", name)
    def run(spark, sf_dir):
        return noisy(spark, sf_dir).select("doc_id", fn(F.col("md")).alias("cleaned"))


def _gone(pattern: str) -> str:
    return f"regexp_replace(md, '{pattern}', '', 'g')"


_clean("clean_page_lines", rules.strip_page_lines, _gone(rules.PAGE_LINE))
_clean("clean_timestamps", rules.strip_timestamps, _gone(rules.LONE_TIMESTAMP))
_clean("clean_terminal_markers", rules.strip_terminal_markers, _gone(rules.TERMINAL_MARKER))
_clean("clean_template_headings", rules.strip_template_headings, _gone(rules.TEMPLATE_HEADING))
_clean("clean_hyphenation", rules.join_hyphenated, f"regexp_replace(md, '{rules.HYPHEN_BREAK}', '\\1\\2', 'g')")
_clean("demote_headings", rules.demote_false_headings, f"regexp_replace(md, '{rules.FALSE_HEADING}', '\\1', 'g')")
_clean("demote_captions", rules.demote_table_captions, f"regexp_replace(md, '{rules.TABLE_CAPTION}', '\\1', 'g')")
_clean("clean_results", rules.clean_results, f"regexp_replace(md, '{rules.RESULT_NOISE}', '\\1\\2', 'g')")
_clean("collapse_rules", rules.collapse_rules, f"regexp_replace(md, '{rules.RULES_RUN}', '---' || chr(10), 'g')")
_clean("strip_comments", rules.strip_comments, _gone(rules.COMMENT))
_clean("clean_whitespace", rules.normalise_blanks, "regexp_replace(regexp_replace(regexp_replace(md, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')")


@query()
def clean_markdown(spark, sf_dir):
    """The whole cleaning; tested against hand-made documents."""
    return noisy(spark, sf_dir).select("doc_id", cleaning.clean_markdown(F.col("md")).alias("cleaned"))


@query()
def html_to_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    return convert(pages).select("page_id", "markdown", "title", "error")


@query()
def html_unescape_full(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.unescape_html(F.col("html")).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS text FROM pages")
def html_unescape_basic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.basic_unescape(F.col("html")).alias("text"))
