"""The build path: documents to Markdown, chunks, enriched texts and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import chunking, enrich, lexical, queryplan, vectors
from quarrymill.session import written
from quarrymill.sources.providers import Embedder, HashEmbedder, embed


@dataclass
class Corpus:
    """chunks (with raw text), meta, the vector store (enriched text, flat metadata, embedding), tokens and abbreviations."""

    chunks: DataFrame
    meta: DataFrame
    store: DataFrame
    index: DataFrame
    abbreviations: DataFrame


def embed_chunks(chunks: DataFrame, meta: DataFrame, store: DataFrame | None = None, embedder: Embedder | None = None, force: bool = False) -> DataFrame:
    """Rows for the store: atomic chunks that it lacks, enriched and embedded."""
    leaves = vectors.to_embed(chunks, store, force=force) if store is not None else chunking.of_tier(chunks, 3)
    rich = enrich.with_enriched(leaves, meta)
    flat = enrich.flat_metadata(rich).join(rich.select("chunk_id", "enriched"), "chunk_id")
    return embed(flat, "enriched", embedder or HashEmbedder())


def build(markdown: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig(), embedder: Embedder | None = None, clean: bool = False) -> Corpus:
    """From (doc_id, markdown) to a searchable corpus."""
    from quarrymill.operators.cleaning import clean_markdown

    docs = markdown.withColumn("markdown", clean_markdown(F.col("markdown"))) if clean else markdown
    chunks, meta = chunking.chunk_documents(docs, config)
    chunks = written(chunks, "chunks")
    return assemble(chunks, meta, written(embed_chunks(chunks, meta, embedder=embedder), "vectors"))


def assemble(chunks: DataFrame, meta: DataFrame, store: DataFrame) -> Corpus:
    leaves = chunking.of_tier(chunks, 3)
    index = written(lexical.indexed(leaves, ["doc_id", "chunk_id"]), "index")
    tables = written(queryplan.abbreviations(leaves.where("chunk_type = 'abbreviation_table'"), order=["ord"]), "abbreviations")
    return Corpus(chunks, meta, store, index, tables)
