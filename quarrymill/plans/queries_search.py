"""Queries over query analysis, lookup, lexical and vector search, fusion, reranking and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators import fusion, lexical, lookup, metrics, queryplan, rerank, vectors
from quarrymill.plans.catalogue import query, table
from quarrymill.plans.queries_ingest import LINES

KEYS = ["doc_id", "ord"]
TOKENS = f"SELECT doc_id, ord, token FROM (SELECT doc_id, ord, unnest(string_split_regex(lower(text), '[^a-zA-Z0-9_-]+')) AS token FROM ({LINES})) WHERE token <> ''"
INDEX = f"t AS ({TOKENS}), ix AS (SELECT doc_id, ord, token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id, ord) AS dl FROM t GROUP BY doc_id, ord, token)"
SCORES = f"""{INDEX}, st AS (SELECT count(*) AS n, avg(dl) AS mean FROM (SELECT DISTINCT doc_id, ord, dl FROM ix)),
  raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM ix, st GROUP BY token),
  w AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-zA-Z0-9_-]+')) AS token FROM benchmark) WHERE token <> '' GROUP BY ALL),
  s AS (SELECT item_id, doc_id, ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM ix JOIN q USING (token) JOIN w USING (token), st GROUP BY ALL HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) > 0)"""


def ranked_sql(where: str = "") -> str:
    return f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id, ord) AS rank FROM s {where})"


def line_index(spark, sf_dir) -> DataFrame:
    return lexical.indexed(lexical.lines_as_chunks(table(spark, sf_dir, "documents")), KEYS, tokenizer=lexical.plain_tokens)


def bm25(spark, sf_dir, allowed: DataFrame | None = None, n: int = 20) -> DataFrame:
    return lexical.bm25_top(table(spark, sf_dir, "benchmark"), line_index(spark, sf_dir), KEYS, n, allowed, "item_id", tokenizer=lexical.plain_tokens)


@query(f"SELECT doc_id, token, count(*) AS n FROM ({TOKENS}) GROUP BY doc_id, token")
def tokenize_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(lexical.plain_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query()
def compound_tokens(spark, sf_dir):
    """Tokens with compounds kept, of rendered blocks; tested against hand-made texts."""
    from quarrymill.plans.queries_structure import block_rows

    return block_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(lexical.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {INDEX} SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, ord FROM ix)) AS n_chunks, round((SELECT avg(dl) FROM (SELECT DISTINCT doc_id, ord, dl FROM ix)), 6) AS avg_len, (SELECT count(DISTINCT token) FROM ix) AS n_tokens")
def bm25_index_stats(spark, sf_dir):
    return lexical.index_stats(line_index(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"{ranked_sql()} SELECT item_id, doc_id, CAST(ord AS INTEGER) AS ord, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"{ranked_sql("WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")} SELECT item_id, doc_id, CAST(ord AS INTEGER) AS ord, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def bm25_scoped(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")
    return bm25(spark, sf_dir, allowed).withColumn("score", F.round("score", 6))


@query(f"{ranked_sql()} SELECT item_id, doc_id, CAST(ord AS INTEGER) AS ord, round(score / max(score) OVER (PARTITION BY item_id), 6) AS normalised FROM r WHERE rank <= 20")
def bm25_normalised(spark, sf_dir):
    hits = lexical.normalise_scores(bm25(spark, sf_dir), "item_id")
    return hits.select("item_id", *KEYS, F.round("normalised", 6).alias("normalised"))


NEAR = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  c AS (SELECT q.vec_id AS query_id, q.label AS q_label, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS cos FROM v q JOIN v ON {on} WHERE q.vec_id % 25 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM c)"""


def asked(spark, sf_dir, step: int = 25) -> DataFrame:
    """The stated query set: vectors whose id the step divides."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


@query(f"WITH {NEAR.format(on='true')} SELECT query_id, vec_id, round(greatest(cos, 0), 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20")
def knn_cosine(spark, sf_dir):
    return vectors.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings")).withColumn("score", F.round("score", 6))


@query(f"WITH {NEAR.format(on='q.label = v.label')} SELECT query_id, vec_id, round(greatest(cos, 0), 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20")
def knn_scoped(spark, sf_dir):
    return vectors.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), scope=[("label", "label")]).withColumn("score", F.round("score", 6))


@query(f"WITH {NEAR.format(on='v.label = 3')} SELECT query_id, vec_id, round(greatest(cos, 0), 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20")
def knn_filtered(spark, sf_dir):
    return vectors.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), filters={"label": 3}).withColumn("score", F.round("score", 6))


# Both lists rank documents: vectors by id, the best lines by their document's best.
FUSED = f"""{SCORES}, {NEAR.format(on='true')}, top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id, ord) AS nth FROM s),
  b AS (SELECT item_id AS query_id, doc_id, max(score) AS score FROM top WHERE nth <= 20 GROUP BY ALL),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b),
  vl AS (SELECT query_id // 25 AS query_id, vec_id AS doc_id, rank AS vec_rank, greatest(cos, 0) AS vector_score FROM k WHERE rank <= 20), bl AS (SELECT query_id, doc_id, rank AS bm25_rank, score AS bm25_score FROM b2 WHERE rank <= 20),
  f AS (SELECT coalesce(vl.query_id, bl.query_id) AS query_id, coalesce(vl.doc_id, bl.doc_id) AS doc_id, vec_rank, bm25_rank, coalesce(vector_score, 0) AS vector_score, coalesce(bm25_score, 0) AS bm25_score,
    coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS score FROM vl FULL JOIN bl ON vl.query_id = bl.query_id AND vl.doc_id = bl.doc_id),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM f)"""


def fused(spark, sf_dir) -> DataFrame:
    near = vectors.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings")).select(F.floor(F.col("query_id") / 25).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    docs = bm25(spark, sf_dir).groupBy(F.col("item_id").alias("query_id"), "doc_id").agg(F.max("score").alias("score"))
    words = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))).where("rank <= 20")
    return fusion.rrf(near, words, ["doc_id"])


@query(f"WITH {FUSED} SELECT query_id, doc_id, round(score, 9) AS score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.round("vector_score", 6).alias("vector_score"), F.round("bm25_score", 6).alias("bm25_score"), "rank")


@query(f"WITH {FUSED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, lang, source, n_chars FROM fr LEFT JOIN documents USING (doc_id) WHERE rank <= 20")
def hybrid_backfill(spark, sf_dir):
    hits = fused(spark, sf_dir).select("query_id", "doc_id", "rank")
    return fusion.backfill(hits, table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"])


# Queries rendered from line items: identifiers, scope words and plain text in turn.
ASK_SQL = """(SELECT l_orderkey, l_linenumber, CASE l_partkey % 7 WHEN 0 THEN 'FVTR_OPT_' || l_suppkey WHEN 1 THEN 'show the HW-IRS_DIM_' || l_suppkey || ' and [HWADD:TOP:' || l_partkey || ']' WHEN 2 THEN 'result of FVTR_PAM_' || l_partkey || ' for 7HA 0' || (1000 + l_suppkey % 9000) || ' ABCD'
   WHEN 3 THEN 'thermal limits of DIM-V in the FVTR' WHEN 4 THEN 'which parts does TOP use' WHEN 5 THEN 'how is ' || l_shipmode || ' tested for ABC:' || l_suppkey ELSE 'insulation of part ' || l_partkey END AS q FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'RAIL' ELSE 'AIR' END AS l_shipmode FROM lineitem))"""


def asked_text(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    n = F.col("l_partkey") % 7
    q = (
        F.when(n == 0, F.concat(F.lit("FVTR_OPT_"), s)).when(n == 1, F.concat(F.lit("show the HW-IRS_DIM_"), s, F.lit(" and [HWADD:TOP:"), p, F.lit("]")))
        .when(n == 2, F.concat(F.lit("result of FVTR_PAM_"), p, F.lit(" for 7HA 0"), (1000 + F.col("l_suppkey") % 9000).cast("string"), F.lit(" ABCD"))).when(n == 3, "thermal limits of DIM-V in the FVTR").when(n == 4, "which parts does TOP use")
        .when(n == 5, F.concat(F.lit("how is "), F.when(F.col("l_returnflag") == "R", "RAIL").otherwise("AIR"), F.lit(" tested for ABC:"), s)).otherwise(F.concat(F.lit("insulation of part "), p))
    )
    return l.select("l_orderkey", "l_linenumber", q.alias("query"))


IDS_SQL = f"""i AS (SELECT *, regexp_extract_all(q, '(?i)\\b(FVT[SR]?_[A-Z]+_\\d+)\\b', 1) AS tc, regexp_extract_all(q, '(?i)\\b(HW-IRS_\\w+)\\b', 1) AS rq, list_transform(regexp_extract_all(q, '(?i)\\b(7HA[\\s-]\\d{{5}}[\\s-][A-Z]{{4}})\\b', 1), lambda x: replace(x, ' ', '-')) AS co,
    regexp_extract_all(q, '\\[([A-Z][A-Z0-9_:]+(?::[A-Z0-9_]+)+)\\]', 1) AS br,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?i)\\bFVT[SR]?_[A-Z]+_\\d+\\b', ' ', 'g'), '(?i)\\bHW-IRS_\\w+\\b', ' ', 'g'), '(?i)\\b7HA[\\s-]\\d{{5}}[\\s-][A-Z]{{4}}\\b', ' ', 'g'), '\\[[A-Z][A-Z0-9_:]+(?::[A-Z0-9_]+)+\\]', ' ', 'g') AS r0 FROM {ASK_SQL}),
  j AS (SELECT *, list_concat(br, regexp_extract_all(r0, '\\b([A-Z]{{2,}}(?::[A-Z0-9_]+)+)\\b', 1)) AS cr, regexp_replace(r0, '\\b[A-Z]{{2,}}(?::[A-Z0-9_]+)+\\b', ' ', 'g') AS r1 FROM i)"""
ROUTE_SQL = f"""{IDS_SQL}, d AS (SELECT *, regexp_extract(r1, '(?i)\\b(FVTR|HwIRS|HW-IRS|HWIRS)\\b', 1) AS dt, regexp_replace(r1, '(?i)\\b(FVTR|HwIRS|HW-IRS|HWIRS)\\b', ' ') AS r2 FROM j),
  m AS (SELECT *, regexp_extract(r2, '(?i)\\b(DIM-(?:V|VI|NV)|DIM|PAM)\\b', 1) AS mo, regexp_replace(r2, '(?i)\\b(DIM-(?:V|VI|NV)|DIM|PAM)\\b', ' ') AS r3 FROM d),
  y AS (SELECT *, dt = '' AND mo = '' AND regexp_matches(r3, '(?i)\\bTOP\\b') AS sys FROM m), z AS (SELECT *, trim(regexp_replace(CASE WHEN sys THEN regexp_replace(r3, '(?i)\\bTOP\\b', ' ') ELSE r3 END, '\\s+', ' ', 'g')) AS rest FROM y),
  a AS (SELECT *, len(tc) + len(rq) + len(co) + len(cr) > 0 AS ids, len(list_filter(string_split(lower(rest), ' '), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(f"'{w}'" for w in queryplan.STOP_WORDS)}], w))) > 0 AS said FROM z)"""


@query(f"WITH {IDS_SQL} SELECT l_orderkey, l_linenumber, array_to_string(list_distinct(tc), ';') AS test_case_ids, array_to_string(list_distinct(rq), ';') AS requirement_ids, array_to_string(list_distinct(co), ';') AS component_ids, array_to_string(list_distinct(cr), ';') AS cross_references FROM j")
def query_identifiers(spark, sf_dir):
    found = queryplan.identifiers(asked_text(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", *[F.array_join(c, ";").alias(c) for c in ("test_case_ids", "requirement_ids", "component_ids", "cross_references")])


@query(f"WITH {ROUTE_SQL} SELECT l_orderkey, l_linenumber, CASE upper(dt) WHEN 'FVTR' THEN 'FVTR' WHEN '' THEN NULL ELSE 'HwIRS' END AS doc_type, CASE upper(mo) WHEN '' THEN NULL WHEN 'DIM-VI' THEN 'DIM-V' ELSE upper(mo) END AS module_name, rest AS remainder FROM a")
def scope_filters(spark, sf_dir):
    return queryplan.analyse(asked_text(spark, sf_dir)).select("l_orderkey", "l_linenumber", "doc_type", "module_name", "remainder")


@query(f"WITH {ROUTE_SQL} SELECT l_orderkey, l_linenumber, ids AS has_identifiers, CASE WHEN ids AND NOT said THEN 'exact_lookup' WHEN ids OR dt <> '' OR mo <> '' OR sys THEN 'scoped_semantic' ELSE 'unconstrained' END AS strategy, CASE WHEN rest <> '' THEN rest ELSE q END AS search_text FROM a")
def query_routing(spark, sf_dir):
    return queryplan.analyse(asked_text(spark, sf_dir)).select("l_orderkey", "l_linenumber", "has_identifiers", "strategy", "search_text")


ABBR_SQL = """(SELECT r_regionkey AS doc_id, 0 AS ord, '| Abbreviation | Meaning |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || substr(n_name, 1, 3) || ' |  nation   of ' || r_name || ' |', chr(10) ORDER BY n_nationkey) AS text
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey)"""


def abbreviation_chunks(spark, sf_dir) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), F.substring("n_name", 1, 3), F.lit(" |  nation   of "), "r_name", F.lit(" |"))
    rows = both.groupBy(F.col("r_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("t")))).alias("l"))
    return rows.select("doc_id", F.lit(0).alias("ord"), F.concat(F.lit("| Abbreviation | Meaning |\n|---|---|\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("text"))


ABBR_ROWS = f"""(SELECT DISTINCT doc_id, upper(short) AS acronym, expansion FROM (SELECT doc_id, trim(regexp_replace(regexp_extract(line, '^\\|\\s*([^|]+?)\\s*\\|\\s*([^|]+?)\\s*\\|', 1), '\\s+', ' ', 'g')) AS short,
    trim(regexp_replace(regexp_extract(line, '^\\|\\s*([^|]+?)\\s*\\|\\s*([^|]+?)\\s*\\|', 2), '\\s+', ' ', 'g')) AS expansion FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {ABBR_SQL})) WHERE short <> '' AND lower(short) <> 'abbreviation' AND NOT regexp_matches(short, '^[\\s|:-]+$'))"""


@query(f"SELECT doc_id, acronym, expansion FROM {ABBR_ROWS}")
def abbreviation_map(spark, sf_dir):
    return queryplan.abbreviations(abbreviation_chunks(spark, sf_dir), order=["ord"]).select("doc_id", "acronym", "expansion")


@query(f"SELECT acronym, expansion, CAST(row_number() OVER (PARTITION BY acronym ORDER BY d, expansion) AS INTEGER) AS ord FROM (SELECT acronym, expansion, min(doc_id) AS d FROM {ABBR_ROWS} GROUP BY ALL)")
def abbreviation_expansions(spark, sf_dir):
    return queryplan.expansions(queryplan.abbreviations(abbreviation_chunks(spark, sf_dir), order=["ord"]))


ACRO_ASK = "(SELECT c_custkey, 'Trade of ' || upper(substr(n_name, 1, 3)) || ' and ' || n_name || ' in ' || c_mktsegment AS q FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def acronym_queries(spark, sf_dir) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", F.concat(F.lit("Trade of "), F.upper(F.substring("n_name", 1, 3)), F.lit(" and "), "n_name", F.lit(" in "), "c_mktsegment").alias("query"))


@query(f"SELECT DISTINCT c_custkey, unnest(regexp_extract_all(q, '\\b([A-Z][A-Z0-9]{{1,}}(?:-[A-Z]{{1,3}})?)\\b', 1)) AS acronym FROM {ACRO_ASK}")
def acronyms(spark, sf_dir):
    return acronym_queries(spark, sf_dir).select("c_custkey", F.explode(queryplan.acronyms(F.col("query"))).alias("acronym"))


@query(f"""WITH e AS (SELECT acronym, expansion, row_number() OVER (PARTITION BY acronym ORDER BY d, expansion) AS ord FROM (SELECT acronym, expansion, min(doc_id) AS d FROM {ABBR_ROWS} GROUP BY ALL)),
  a AS (SELECT c_custkey, q, generate_subscripts(l, 1) AS nth, unnest(l) AS acronym FROM (SELECT c_custkey, q, regexp_extract_all(q, '\\b([A-Z][A-Z0-9]{{1,}}(?:-[A-Z]{{1,3}})?)\\b', 1) AS l FROM {ACRO_ASK})),
  p AS (SELECT c_custkey, expansion, min(nth * 1000 + ord) AS place FROM a JOIN e USING (acronym) GROUP BY ALL), t AS (SELECT c_custkey, string_agg(expansion, ' ' ORDER BY place) AS tail FROM p GROUP BY ALL)
SELECT c_custkey, q || coalesce(' ' || tail, '') AS expanded FROM {ACRO_ASK} LEFT JOIN t USING (c_custkey)""")
def expand_query(spark, sf_dir):
    found = queryplan.abbreviations(abbreviation_chunks(spark, sf_dir), order=["ord"])
    return queryplan.expand(acronym_queries(spark, sf_dir), found, "c_custkey").select("c_custkey", "expanded")


# A store of parts: one id field, one delimited field, a text.
STORE_SQL = "(SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_type || '; ' || p_brand END AS kinds, p_name AS text FROM part)"


def part_store(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit("; "), "p_brand"))
    return p.select("p_partkey", F.col("p_brand").alias("brand"), kinds.alias("kinds"), F.col("p_name").alias("text"))


def wanted(spark, sf_dir, column) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("part"), F.col("s_suppkey").alias("query_id")).join(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part"), "part").select("query_id", column.alias("value"))


WANT_SQL = "(SELECT s_suppkey AS query_id, {col} AS value FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 10 = 0)"


@query(f"SELECT DISTINCT query_id, p_partkey FROM {WANT_SQL.format(col='p_brand')} w JOIN {STORE_SQL} s ON s.brand = w.value")
def lookup_field(spark, sf_dir):
    return lookup.by_field(wanted(spark, sf_dir, F.col("p_brand")), part_store(spark, sf_dir), "brand", ["p_partkey"])


DELIMITED = f"""w AS (SELECT * FROM {WANT_SQL.format(col='p_type')} UNION SELECT * FROM {WANT_SQL.format(col='lower(p_brand)')}), s AS (SELECT * FROM {STORE_SQL}), x AS (SELECT query_id, value, p_partkey FROM w JOIN s ON kinds = value)
  SELECT DISTINCT query_id, p_partkey FROM (SELECT query_id, p_partkey FROM x UNION ALL SELECT query_id, p_partkey FROM w JOIN s ON list_contains(list_transform(string_split(lower(kinds), ';'), lambda k: trim(k)), lower(value)) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = w.query_id AND x.value = w.value))"""


def delimited_values(spark, sf_dir) -> DataFrame:
    return wanted(spark, sf_dir, F.col("p_type")).union(wanted(spark, sf_dir, F.lower("p_brand"))).distinct()


@query(f"WITH {DELIMITED}")
def lookup_delimited(spark, sf_dir):
    return lookup.by_delimited(delimited_values(spark, sf_dir), part_store(spark, sf_dir), "kinds", ["p_partkey"])


FIRST_WORD = "split_part(p_name, ' ', 1)"


@query(f"SELECT DISTINCT query_id, p_partkey FROM {WANT_SQL.format(col=FIRST_WORD)} w JOIN {STORE_SQL} s ON contains(lower(s.text), lower(w.value))")
def lookup_text_scan(spark, sf_dir):
    return lookup.by_text(wanted(spark, sf_dir, F.substring_index("p_name", " ", 1)), part_store(spark, sf_dir), ["p_partkey"])


@query(f"""SELECT DISTINCT query_id, p_partkey, 1.0::DOUBLE AS score FROM (SELECT query_id, p_partkey FROM {WANT_SQL.format(col='p_brand')} w JOIN {STORE_SQL} s ON s.brand = w.value UNION ALL
  SELECT query_id, p_partkey FROM {WANT_SQL.format(col=FIRST_WORD)} w JOIN {STORE_SQL} s ON contains(lower(s.text), lower(w.value)) UNION ALL (WITH {DELIMITED}))""")
def exact_lookup(spark, sf_dir):
    kinds = {"test_case": wanted(spark, sf_dir, F.col("p_brand")), "component": wanted(spark, sf_dir, F.substring_index("p_name", " ", 1)), "requirement": delimited_values(spark, sf_dir)}
    return lookup.exact_lookup(kinds, part_store(spark, sf_dir), ["p_partkey"], columns={"test_case": "brand", "requirement": "kinds"})


HITS = f"WITH {NEAR.format(on='true')}, h AS (SELECT query_id, vec_id, rank, greatest(cos, 0) AS score FROM k WHERE rank <= 20)"


def hits(spark, sf_dir) -> DataFrame:
    return vectors.nearest(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query(f"""{HITS}, r AS (SELECT *, CAST((vec_id * 7) % 11 AS DOUBLE) AS raw FROM h), s AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS rerank_score FROM r WINDOW w AS (PARTITION BY query_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank) AS new_rank FROM s) SELECT query_id, vec_id, round(rerank_score, 6) AS rerank_score, CAST(new_rank AS INTEGER) AS new_rank FROM n WHERE new_rank <= 8""")
def rerank_minmax(spark, sf_dir):
    raw = hits(spark, sf_dir).withColumn("raw", ((F.col("vec_id") * 7) % 11).cast("double"))
    return rerank.min_max(raw).select("query_id", "vec_id", F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


@query(f"""{HITS}, s AS (SELECT *, least(10, greatest(0, coalesce(CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 17) - 3 END, 0))) / 10.0::DOUBLE AS rerank_score FROM h),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank) AS new_rank FROM s) SELECT query_id, vec_id, round(rerank_score, 6) AS rerank_score, CAST(new_rank AS INTEGER) AS new_rank FROM n WHERE new_rank <= 8""")
def rerank_clamped(spark, sf_dir):
    raw = hits(spark, sf_dir).withColumn("raw", F.when(F.col("vec_id") % 5 != 0, F.col("vec_id") % 17 - 3))
    return rerank.clamped(raw).select("query_id", "vec_id", F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


@query(f"{HITS} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 8")
def rerank_none(spark, sf_dir):
    return rerank.reranker("none")(hits(spark, sf_dir)).select("query_id", "vec_id", "rank")


METRICS = f"""{HITS}, g AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 25 = 0 AND v.vec_id % 3 = 0), qs AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 25 = 0),
  j AS (SELECT h.*, CASE WHEN g.vec_id IS NULL THEN 0 ELSE 1 END AS rel FROM h LEFT JOIN g ON g.query_id = h.query_id AND g.vec_id = h.vec_id), a AS (SELECT query_id, count(*) AS n, sum(rel) AS found, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg FROM j GROUP BY 1), w AS (SELECT query_id, count(*) AS n_rel FROM g GROUP BY 1),
  m AS (SELECT query_id, label, CASE WHEN coalesce(n, 0) > 0 THEN found / n ELSE 0 END AS precision, CASE WHEN coalesce(n_rel, 0) > 0 THEN found / n_rel ELSE 1 END AS recall, coalesce(1.0 / first, 0) AS reciprocal_rank,
    CASE WHEN coalesce(n_rel, 0) = 0 THEN 1 ELSE dcg / list_sum(list_transform(range(1, CAST(least(n, n_rel) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))) END AS ndcg, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END AS hit FROM qs LEFT JOIN a USING (query_id) LEFT JOIN w USING (query_id))"""


def scored(spark, sf_dir) -> DataFrame:
    queries = asked(spark, sf_dir).select("query_id", "label")
    relevant = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("label", F.col("vec_id").alias("item_id"))
    return metrics.retrieval_metrics(queries, hits(spark, sf_dir).withColumnRenamed("vec_id", "item_id"), relevant, by="label")


NAMES = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.RETRIEVAL)


@query(f"{METRICS} SELECT query_id, label, {NAMES} FROM m", hit="DOUBLE")
def retrieval_metrics(spark, sf_dir):
    return metrics.report(scored(spark, sf_dir), 6)


@query(f"{METRICS} SELECT CASE WHEN grouping(label) = 1 THEN 'overall' ELSE CAST(label AS VARCHAR) END AS query_type, count(*) AS n_queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in metrics.RETRIEVAL)} FROM m GROUP BY GROUPING SETS ((label), ())")
def retrieval_metrics_by_type(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("query_type", F.col("label").cast("string")).drop("label")
    return metrics.report(metrics.stratified(rows, "query_type"), 6)
