"""The query path for a batch of queries: route, search, fuse, rerank, assemble.  One plan keyed by query_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators import context, fusion, lexical, lookup, queryplan, rerank, vectors
from quarrymill.plans.corpus import Corpus
from quarrymill.session import written
from quarrymill.sources.config import RetrievalConfig
from quarrymill.sources.providers import Embedder, HashEmbedder, LexicalPairScorer, embed, pair_scores

KEYS = ["doc_id", "chunk_id"]


@dataclass
class Retrieval:
    """analysis per query; hits (query_id, chunk_id, score, vector_score, bm25_score, rank, text); sections; windows."""

    analysis: DataFrame
    hits: DataFrame
    sections: DataFrame
    windows: DataFrame


def exact_hits(analysis: DataFrame, corpus: Corpus) -> DataFrame:
    """Hits of exact lookups: every one, in order of chunk id, with score 1."""
    asked = analysis.where("strategy = 'exact_lookup'")
    kinds = {"test_case": "test_case_ids", "requirement": "requirement_ids", "cross_reference": "cross_references", "component": "component_ids"}
    wanted = {k: asked.select("query_id", F.explode(c).alias("value")) for k, c in kinds.items()}
    found = lookup.exact_lookup(wanted, corpus.store, KEYS, "enriched")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))


def hybrid_hits(analysis: DataFrame, corpus: Corpus, config: RetrievalConfig, embedder: Embedder | None = None) -> DataFrame:
    """Vector and lexical candidates of the search text, fused and cut; texts are joined after the cut.

    A scoped query's vector search sees its document type and module alone; the lexical search and the expansion see everything.
    """
    asked = analysis
    if config.expand_abbreviations:
        asked = queryplan.expand(asked, corpus.abbreviations, text_col="search_text")
    else:
        asked = asked.withColumn("expanded", F.col("search_text"))
    asked = written(embed(asked, "expanded", embedder or HashEmbedder(), out="vector"), "asked")
    n = config.top_k_broad
    key = F.xxhash64("chunk_id")
    pool = corpus.store.select(key.alias("vec_id"), "chunk_id", "doc_id", "doc_type", "module_name", "embedding")
    scope = [F.col("doc_type").isNotNull().alias("by_type"), F.col("module_name").isNotNull().alias("by_module")]
    flagged = asked.select("query_id", "vector", "doc_type", "module_name", *scope)
    parts = []
    for by_type in (False, True):
        for by_module in (False, True):
            pairs = [(c, c) for c, on in (("doc_type", by_type), ("module_name", by_module)) if on]
            some = flagged.where((F.col("by_type") == by_type) & (F.col("by_module") == by_module))
            parts.append(vectors.nearest(some, pool, n, scope=pairs))
    near = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).join(pool.select("vec_id", *KEYS), "vec_id")
    words = lexical.normalise_scores(lexical.bm25_top(asked, corpus.index, KEYS, n, text_col="expanded"))
    fused = fusion.rrf(near.select("query_id", *KEYS, "rank", "score"), words.select("query_id", *KEYS, "rank", F.col("normalised").alias("score")), KEYS, n, config.rrf_k)
    texts = corpus.store.select("chunk_id", F.col("enriched").alias("text"))
    return fusion.backfill(fused, texts, ["chunk_id"]).join(asked.select("query_id", "expanded"), "query_id")


def retrieve(queries: DataFrame, corpus: Corpus, config: RetrievalConfig = RetrievalConfig(), embedder: Embedder | None = None, scorer: Callable | None = None) -> Retrieval:
    """queries: (query_id, query).  An exact lookup without a hit falls through to the search and keeps its label."""
    analysis = written(queryplan.analyse(queries, keep_ids_in_text=config.keep_ids_in_text), "analysis")
    exact = written(exact_hits(analysis, corpus), "exact")
    exact = fusion.backfill(exact, corpus.store.select("chunk_id", F.col("enriched").alias("text")), ["chunk_id"])
    open_queries = analysis.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    found = written(hybrid_hits(open_queries, corpus, config, embedder), "hybrid")
    again = rerank.reranker(config.reranker)
    if again is rerank.unchanged:
        best = again(found, config.top_k_final)
    else:
        scored = pair_scores(found, "expanded", "text", scorer or LexicalPairScorer())
        best = again(scored, config.top_k_final).withColumn("rank", F.col("new_rank"))
    cols = ["query_id", *KEYS, "score", "vector_score", "bm25_score", "rank", "text"]
    zero = F.lit(0.0)
    hits = written(exact.withColumns({"vector_score": zero, "bm25_score": zero}).select(*cols).unionByName(best.select(*cols)), "hits")
    sections = written(context.within_budget(context.group_sections(hits.select("query_id", "chunk_id", "score", "rank", "text"), corpus.chunks), config.max_context_tokens), "sections")
    return Retrieval(analysis, hits, sections, context.windows(sections, corpus.meta.select("doc_id", "doc_type")))
