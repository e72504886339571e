"""Queries over context, citations, verification, confidence and answer metrics; and both whole paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import answers, context, lexical, metrics
from quarrymill.plans.catalogue import query, table
from quarrymill.plans.queries_ingest import LINES

# Lines as chunks under parts of ten lines; each part is a section.
CHUNK_SQL = f"""(SELECT doc_id, ord, doc_id || ':' || ord AS chunk_id, doc_id || '/' || (ord // 10) AS parent_id, CASE ord % 5 WHEN 2 THEN 'table' WHEN 4 THEN 'list' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'test_case' ELSE 'prose' END ELSE 'prose' END AS chunk_type, text FROM ({LINES}))"""


def store(spark, sf_dir) -> DataFrame:
    """Atomic chunks and their sections, in one table as the chunker makes it."""
    lines = lexical.lines_as_chunks(table(spark, sf_dir, "documents"))
    o, d = F.col("ord"), F.col("doc_id")
    part = F.concat(d.cast("string"), F.lit("/"), F.floor(o / 10).cast("string"))
    kind = F.when(o % 5 == 2, "table").when(o % 5 == 4, "list").when((o % 5 == 3) & (d % 2 == 0), "test_case").otherwise("prose")
    leaves = lines.select("doc_id", "ord", F.concat_ws(":", "doc_id", "ord").alias("chunk_id"), part.alias("parent_id"), kind.alias("chunk_type"), "text", F.lit(3).alias("tier"), F.lit(False).alias("has_table"), F.lit(False).alias("has_figure"))
    number = F.regexp_extract("parent_id", "/(.*)$", 1)
    secs = leaves.select("doc_id", "parent_id").distinct().select(
        "doc_id", F.lit(0).alias("ord"), F.col("parent_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("section").alias("chunk_type"), F.lit("").alias("text"), F.lit(2).alias("tier"), F.lit(False).alias("has_table"),
        F.lit(False).alias("has_figure"), F.concat(F.lit("Part "), number).alias("heading"), F.when(number != "0", number).alias("section_number"),
    )
    return leaves.unionByName(secs, allowMissingColumns=True)


# Each benchmark item takes a spread of lines as its hits.
HIT_SQL = f"""h AS (SELECT item_id AS query_id, c.*, 1.0::DOUBLE / (1 + (c.doc_id * 7 + c.ord * 3 + item_id) % 50) AS score FROM benchmark JOIN {CHUNK_SQL} c ON (c.doc_id + c.ord) % 40 = item_id % 40 AND c.doc_id % 5 = item_id % 5),
  hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank FROM h)"""


def hits(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    leaves = store(spark, sf_dir).where("tier = 3").withColumns({"m40": (F.col("doc_id") + F.col("ord")) % 40, "m5": F.col("doc_id") % 5})
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m40"), (F.col("item_id") % 5).alias("m5"))
    score = F.lit(1.0) / (1 + (F.col("doc_id") * 7 + F.col("ord") * 3 + F.col("query_id")) % 50)
    found = leaves.join(items, ["m40", "m5"]).withColumn("score", score)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ord"))).select("query_id", "chunk_id", "doc_id", "ord", "chunk_type", "text", "score", "rank")


GROUPS = f"""{HIT_SQL}, l AS (SELECT *, lag(chunk_type) OVER w AS was, lag(chunk_id) OVER w AS lead_id, lag(text) OVER w AS lead_text FROM {CHUNK_SQL} WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY ord)),
  led AS (SELECT chunk_id, lead_id, lead_text FROM l WHERE chunk_type IN ('table', 'list') AND was = 'prose'),
  k AS (SELECT hr.*, lead_id, lead_text FROM hr LEFT JOIN led USING (chunk_id)),
  g AS (SELECT query_id, parent_id AS parent_key, max(score) AS best, min(rank) AS first, any_value(doc_id) AS doc_id, 'Part ' || regexp_extract(parent_id, '/(.*)$', 1) AS section_heading, nullif(regexp_extract(parent_id, '/(.*)$', 1), '0') AS number,
    string_agg(chunk_id, ',' ORDER BY ord) AS children, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS said, list_sort(list_distinct(list(chunk_type))) AS types, string_agg(lead_text, chr(10) || chr(10) ORDER BY ord) AS preamble, string_agg(lead_id, ',' ORDER BY ord) AS leads FROM k GROUP BY query_id, parent_id),
  t AS (SELECT *, section_heading || CASE WHEN coalesce(preamble, '') <> '' THEN chr(10) || chr(10) || preamble ELSE '' END || CASE WHEN said <> '' THEN chr(10) || chr(10) || said ELSE '' END AS whole FROM g),
  s AS (SELECT *, CASE WHEN regexp_matches(whole, '\\S') THEN length(whole) // 4 ELSE 0 END AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, coalesce(number, 'zzz'), first) AS position FROM t)"""


def sections(spark, sf_dir) -> DataFrame:
    return context.group_sections(hits(spark, sf_dir).select("query_id", "chunk_id", "score", "rank"), store(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT query_id, parent_key, section_heading, children, round(best, 6) AS best, CAST(position AS INTEGER) AS position, CAST(tokens AS INTEGER) AS token_count FROM s")
def context_groups(spark, sf_dir):
    return sections(spark, sf_dir).select("query_id", "parent_key", "section_heading", F.array_join(F.transform("children", lambda c: c["chunk_id"]), ",").alias("children"), F.round("best", 6).alias("best"), "position", "token_count")


@query(f"WITH {GROUPS} SELECT chunk_id, lead_id, md5(lead_text) AS lead FROM led")
def context_preamble(spark, sf_dir):
    return context.preambles(store(spark, sf_dir)).select("chunk_id", "lead_id", F.md5("lead_text").alias("lead"))


@query(f"WITH {GROUPS}, b AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS upto FROM s) SELECT query_id, parent_key, CAST(position AS INTEGER) AS position FROM b WHERE position = 1 OR upto <= 300")
def context_budget(spark, sf_dir):
    return context.within_budget(sections(spark, sf_dir), 300).select("query_id", "parent_key", "position")


@query(f"WITH {GROUPS} SELECT query_id, parent_key, CASE WHEN len(types) = 1 THEN types[1] WHEN list_contains(types, 'test_case') THEN 'test_case' WHEN list_contains(types, 'table') THEN 'table' ELSE 'mixed' END AS content_type_hint FROM s")
def context_hint(spark, sf_dir):
    return sections(spark, sf_dir).select("query_id", "parent_key", "content_type_hint")


@query(f"""WITH {GROUPS}, b AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS upto FROM s), c AS (SELECT * FROM b WHERE position = 1 OR upto <= 300)
SELECT query_id, sum(tokens) AS total_tokens, string_agg(children || coalesce(',' || leads, ''), ',' ORDER BY position) AS chunk_ids,
  regexp_replace(string_agg('### ' || section_heading || CASE WHEN coalesce(preamble, '') <> '' THEN chr(10) || chr(10) || preamble ELSE '' END || chr(10) || chr(10) || said || chr(10) || chr(10), chr(10) || chr(10) ORDER BY position), '\\s+$', '') AS prompt_text FROM c GROUP BY query_id""", total_tokens="BIGINT")
def prompt_text(spark, sf_dir):
    made = context.windows(context.within_budget(sections(spark, sf_dir), 300))
    return made.select("query_id", "total_tokens", F.array_join("chunk_ids", ",").alias("chunk_ids"), "prompt_text")


# Orders as responses, line items as claims: a claim cites one or two of twelve numbers, the manifest has eight.
CLAIM_SQL = "(SELECT o_orderkey AS query_id, l_linenumber - 1 AS claim_index, CASE WHEN l_suppkey % 9 = 0 THEN [] WHEN l_suppkey % 2 = 0 THEN [l_partkey % 12 + 1] ELSE [l_partkey % 12 + 1, l_suppkey % 12 + 1] END AS source_ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
ANSWER_SQL = "(SELECT o_orderkey AS query_id, o_orderpriority LIKE '1%' AS abstained, CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'SURE' END AS model_confidence, (o_custkey % 100) / 100.0::DOUBLE AS best_vector, CASE WHEN o_custkey % 10 = 0 THEN 'exact_lookup' ELSE 'unconstrained' END AS strategy FROM orders)"


def responses(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "MEDIUM").otherwise("SURE")
    return o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").startswith("1").alias("abstained"), level.alias("model_confidence"), (F.col("o_custkey") % 100 / 100).alias("best_vector"), F.when(F.col("o_custkey") % 10 == 0, "exact_lookup").otherwise("unconstrained").alias("strategy"))


def claims(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    p, s = (F.col("l_partkey") % 12 + 1).cast("int"), (F.col("l_suppkey") % 12 + 1).cast("int")
    ids = F.when(F.col("l_suppkey") % 9 == 0, F.array().cast("array<int>")).when(F.col("l_suppkey") % 2 == 0, F.array(p)).otherwise(F.array(p, s))
    rows = l.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("claim_index"), ids.alias("source_ids"))
    return rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id")), "query_id", "left_semi")


def manifest(spark, sf_dir) -> DataFrame:
    """Eight sources for every order."""
    n = F.explode(F.sequence(F.lit(1), F.lit(8)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), n.alias("source_id"))
    sid = F.col("source_id").cast("string")
    return rows.select("query_id", "source_id", F.concat(F.lit("Source label "), sid).alias("label"), F.array(F.concat(F.lit("c"), sid)).alias("chunk_ids"), F.concat(F.lit("d"), (F.col("source_id") % 3).cast("string")).alias("doc_id"), F.lit("FVTR").alias("doc_type"), F.lit("").alias("section_heading"), F.lit("").alias("section_number"))


@query("""WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Heading ' || o_orderkey END AS heading, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS number,
  CASE WHEN o_orderstatus = 'F' THEN 'FVTR' ELSE '' END AS doc_type, CASE WHEN o_orderkey % 5 = 0 THEN 'PAM' ELSE '' END AS module, CASE WHEN o_orderstatus = 'O' THEN 'B' ELSE '' END AS rev, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day FROM orders),
  p AS (SELECT *, trim(doc_type || ' ' || module) AS prefix FROM s), q AS (SELECT *, CASE WHEN prefix <> '' AND number <> '' THEN prefix || ', §' || number || ' — ' WHEN prefix <> '' THEN prefix || ' — ' WHEN number <> '' THEN '§' || number || ' — ' ELSE '' END || CASE WHEN heading = '' THEN '(untitled section)' ELSE heading END AS label FROM p)
SELECT query_id, CAST(position AS INTEGER) AS source_id, label, 'Source ' || position || ': ' || label || CASE WHEN rev <> '' THEN '  (Rev ' || rev || ', ' || day || ')' ELSE '' END || chr(10) || '  Chunk IDs: ' || substr('chunk-of-order-' || doc_id, 1, 12) AS line FROM q""")
def source_manifest(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(
        F.col("o_custkey").alias("query_id"), k.alias("doc_id"), place.alias("position"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Heading "), k.cast("string"))).alias("section_heading"), F.when(k % 3 == 0, "").otherwise((k % 9).cast("string")).alias("section_number"),
        F.array(F.concat(F.lit("chunk-of-order-"), k.cast("string"))).alias("chunk_ids"),
    )
    meta = o.select(
        k.alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "FVTR").otherwise("").alias("doc_type"), F.when(k % 5 == 0, "PAM").otherwise("").alias("module_name"), F.when(F.col("o_orderstatus") == "O", "B").otherwise("").alias("revision"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("revision_date"),
    )
    return answers.source_manifest(rows, meta).select("query_id", "source_id", "label", "line")


@query(f"""WITH c AS (SELECT DISTINCT query_id, unnest(source_ids) AS source_id FROM {CLAIM_SQL})
SELECT query_id, CAST(source_id AS INTEGER) AS source_id, CASE WHEN source_id <= 8 THEN 'Source label ' || source_id ELSE '(unmapped source ' || source_id || ')' END AS label, CASE WHEN source_id <= 8 THEN 'c' || source_id ELSE '' END AS chunk_id, CASE WHEN source_id <= 8 THEN 'd' || (source_id % 3) ELSE '' END AS doc_id, source_id <= 8 AS mapped FROM c""")
def citation_resolution(spark, sf_dir):
    return answers.resolve_citations(claims(spark, sf_dir), manifest(spark, sf_dir)).select("query_id", "source_id", "label", "chunk_id", "doc_id", "mapped")


VERIFY = f"""c AS (SELECT * FROM {CLAIM_SQL}), u AS (SELECT query_id, claim_index, generate_subscripts(source_ids, 1) AS nth, unnest(source_ids) AS source_id FROM c), w AS (SELECT query_id, source_id, min(claim_index * 100 + nth) AS place FROM u WHERE source_id > 8 GROUP BY ALL),
  x AS (SELECT query_id, string_agg(source_id, ',' ORDER BY place, source_id) AS unmapped FROM w GROUP BY ALL), p AS (SELECT query_id, count(*) AS n, count(*) FILTER (len(source_ids) > 0) AS cited, string_agg(claim_index, ',' ORDER BY claim_index) FILTER (len(source_ids) = 0) AS uncited FROM c GROUP BY ALL),
  v AS (SELECT a.*, unmapped IS NULL AS all_citations_resolved, coalesce(cited, 0) = coalesce(n, 0) AS all_claims_cited, unmapped IS NOT NULL AS contains_unmapped_citations, abstained = (coalesce(n, 0) = 0) AS abstention_consistent, CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE cited / n END AS coverage, coalesce(unmapped, '') AS unmapped, coalesce(uncited, '') AS uncited
    FROM {ANSWER_SQL} a LEFT JOIN p USING (query_id) LEFT JOIN x USING (query_id))"""


def verified(spark, sf_dir) -> DataFrame:
    return answers.verify(responses(spark, sf_dir), claims(spark, sf_dir), manifest(spark, sf_dir).select("query_id", "source_id"))


@query(f"WITH {VERIFY} SELECT query_id, all_citations_resolved, all_claims_cited, contains_unmapped_citations, abstention_consistent, round(coverage, 6) AS citation_coverage_ratio, unmapped, uncited FROM v")
def verification(spark, sf_dir):
    return verified(spark, sf_dir).select(
        "query_id", "all_citations_resolved", "all_claims_cited", "contains_unmapped_citations", "abstention_consistent", F.round("citation_coverage_ratio", 6).alias("citation_coverage_ratio"),
        F.array_join("unmapped_source_ids", ",").alias("unmapped"), F.array_join("uncited_claim_indices", ",").alias("uncited"),
    )


CONFIDENCE = f"""{VERIFY}, k AS (SELECT *, CASE WHEN strategy = 'exact_lookup' THEN 1.0 WHEN best_vector >= 0.85 THEN 1.0 WHEN best_vector >= 0.75 THEN 0.85 WHEN best_vector >= 0.65 THEN 0.65 ELSE 0.4 END AS retrieval_support, round(coverage, 4) AS citation_coverage,
    CASE WHEN all_citations_resolved AND abstention_consistent AND NOT contains_unmapped_citations THEN 1.0 ELSE 0.0 END AS verification_pass FROM v),
  y AS (SELECT *, CASE WHEN least(retrieval_support, citation_coverage, verification_pass) >= 0.75 THEN 2 WHEN least(retrieval_support, citation_coverage, verification_pass) >= 0.5 THEN 1 ELSE 0 END AS sys, CASE model_confidence WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS mod FROM k)"""


@query(f"WITH {CONFIDENCE} SELECT query_id, CAST(retrieval_support AS DOUBLE) AS retrieval_support, citation_coverage, CAST(verification_pass AS DOUBLE) AS verification_pass, ['LOW', 'MEDIUM', 'HIGH'][sys + 1] AS system_level, ['LOW', 'MEDIUM', 'HIGH'][least(sys, mod) + 1] AS final_level FROM y")
def confidence(spark, sf_dir):
    rows = verified(spark, sf_dir).join(responses(spark, sf_dir).drop("abstained"), "query_id")
    return answers.confidence(rows).select("query_id", "retrieval_support", "citation_coverage", "verification_pass", "system_level", "final_level")


@query("SELECT item_id AS query_id, true AS abstained, 'LOW' AS final_level, 0.0::DOUBLE AS retrieval_support, 1.0::DOUBLE AS citation_coverage, 1.0::DOUBLE AS verification_pass FROM benchmark WHERE item_id % 4 = 0")
def empty_guard(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    windows = items.select("query_id", F.when(F.col("query_id") % 4 != 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("chunk_ids"))
    return answers.abstentions(items, windows).drop("answer")


@query("SELECT conv_id, turn, turn % 2 = 1 AS ok, CASE WHEN turn % 2 = 1 THEN text END AS answer, CASE WHEN turn % 2 = 1 THEN conv_id % 3 = 0 END AS abstained, CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END AS n_claims FROM conversations")
def parse_structured_response(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.struct(F.col("role").alias("statement"), F.array(F.lit(1)).alias("source_ids"))).alias("claims"), (F.col("conv_id") % 3 == 0).alias("abstained"), F.lit("LOW").alias("confidence")))
    replies = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, body).otherwise("no json").alias("reply"))
    return answers.parse_responses(replies).select("conv_id", "turn", "ok", "answer", "abstained", F.when(F.col("ok"), F.size("claims")).otherwise(0).alias("n_claims"))


# Assistant turns as answers; the user's words of five letters or more are the facts expected.
FACTS = """f AS (SELECT conv_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 5)) AS facts FROM conversations WHERE turn = 0), a AS (SELECT conv_id, text FROM conversations WHERE turn = 1),
  r AS (SELECT conv_id, len(facts) AS n, len(list_filter(facts, lambda w: contains(lower(text), w))) AS found FROM f JOIN a USING (conv_id))"""


def facts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    asked = c.where("turn = 0").select("conv_id", F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 5)).alias("expected_facts"))
    return metrics.fact_recall(asked.join(c.where("turn = 1").select("conv_id", F.col("text").alias("answer")), "conv_id"))


@query(f"WITH {FACTS} SELECT conv_id, found AS n_matched, n - found AS n_missed, round(CASE WHEN n > 0 THEN found / n ELSE 1 END, 6) AS fact_recall FROM r")
def fact_recall(spark, sf_dir):
    return facts(spark, sf_dir).select("conv_id", F.size("matched").cast("long").alias("n_matched"), F.size("missed").cast("long").alias("n_missed"), F.round("fact_recall", 6).alias("fact_recall"))


DOCS = "(SELECT o_orderkey, list_distinct(list(l_suppkey % 6)) AS cited, list_distinct(list(l_partkey % 6) FILTER (l_linenumber < 3 AND o_custkey % 4 > 0)) AS wanted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


def cited_documents(spark, sf_dir) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wanted = F.when((F.col("l_linenumber") < 3) & (F.col("o_custkey") % 4 > 0), F.col("l_partkey") % 6)
    return both.groupBy("o_orderkey").agg(F.collect_set(F.col("l_suppkey") % 6).alias("cited_docs"), F.collect_set(wanted).alias("expected_docs"))


@query(f"SELECT o_orderkey, round(CASE WHEN len(cited) > 0 THEN len(list_intersect(cited, coalesce(wanted, []))) / len(cited) ELSE 1 END, 6) AS doc_precision, round(CASE WHEN coalesce(len(wanted), 0) > 0 THEN len(list_intersect(cited, wanted)) / len(wanted) ELSE 1 END, 6) AS doc_recall FROM {DOCS}")
def doc_pr(spark, sf_dir):
    rows = metrics.document_scores(cited_documents(spark, sf_dir))
    return rows.select("o_orderkey", F.round("doc_precision", 6).alias("doc_precision"), F.round("doc_recall", 6).alias("doc_recall"))


GEN = """g AS (SELECT o_orderkey, o_orderstatus AS query_type, (o_custkey % 3 = 0) = (o_orderkey % 3 = 0) AS abstention_correct, (o_custkey % 2 = 0) = (o_orderkey % 2 = 0) AS partial_correct,
  CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END >= CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS confidence_aligned FROM orders)"""


@query(f"WITH {GEN} SELECT CASE WHEN grouping(query_type) = 1 THEN 'overall' ELSE query_type END AS query_type, count(*) AS n_queries, round(avg(abstention_correct::INT), 6) AS abstention_correct, round(avg(partial_correct::INT), 6) AS partial_correct, round(avg(confidence_aligned::INT), 6) AS confidence_aligned FROM g GROUP BY GROUPING SETS ((query_type), ())")
def gen_metrics_by_type(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    level = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("query_type"), (c % 3 == 0).alias("abstained"), (o % 3 == 0).alias("expected_abstained"), (c % 2 == 0).alias("partial"), (o % 2 == 0).alias("expected_partial"),
        level(c % 3, ["LOW", "MEDIUM", "HIGH"]).alias("final_level"), level(o % 4, ["MEDIUM", "HIGH", "LOW", "odd"]).alias("min_confidence"),
    )
    return metrics.report(metrics.stratified(metrics.flag_scores(rows), "query_type", ("abstention_correct", "partial_correct", "confidence_aligned")), 6)


def _paths(spark, sf_dir):
    from quarrymill.plans.corpus import build
    from quarrymill.plans.queries_structure import markdown
    from quarrymill.plans.retrieve import retrieve

    corpus = build(markdown(spark, sf_dir))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries, corpus, retrieve(queries, corpus)


@query()
def retrieve_batch(spark, sf_dir):
    """The whole query path for every benchmark item over the documents as Markdown."""
    _, _, found = _paths(spark, sf_dir)
    return found.windows.join(found.analysis.select("query_id", "strategy"), "query_id")


@query()
def generate_batch(spark, sf_dir):
    """Answers of the offline stand-in model for every benchmark item."""
    from quarrymill.plans.generate import generate

    queries, corpus, found = _paths(spark, sf_dir)
    rows, _ = generate(queries, found, corpus)
    return rows.select("query_id", "answer", "abstained", "final_level", "retrieval_support", "citation_coverage", "verification_pass", "strategy", "error")
