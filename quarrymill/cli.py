"""Commands: ingest, chunk, embed, retrieve, generate, chat, evaluate-retrieval, evaluate-generation.

No command, or an option first, means ingest.  Exit codes: 0 done, 1 nothing selected, found or known, 2 failed.
"""

from __future__ import annotations

import argparse
import sys
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from quarrymill.operators import chunking, metrics
from quarrymill.plans import corpus as corpora
from quarrymill.plans import evaluate as evaluation
from quarrymill.plans.generate import generate, render
from quarrymill.plans.retrieve import retrieve
from quarrymill.session import build_session, written
from quarrymill.sources import registry, selection, store
from quarrymill.sources.config import RetrievalConfig, ensure_folders
from quarrymill.sources.providers import convert_files


class Tables:
    """Where the commands keep their tables."""

    def __init__(self, root: str) -> None:
        self.markdown, self.chunks, self.meta, self.vectors, self.registry = (f"{root}/{n}" for n in ("markdown", "chunks", "meta", "vectors", "registry"))

    def corpus(self, spark) -> corpora.Corpus:
        return corpora.assemble(store.read_chunks(spark, self.chunks), store.read_rows(spark, self.meta), store.read_rows(spark, self.vectors))


def ingest(spark, a, tables: Tables) -> int:
    if a.paths and a.manifest:
        print("paths and --manifest exclude each other", file=sys.stderr)
        return 2
    chosen = selection.select_documents(a.paths, a.manifest, a.input)
    for w in chosen.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if not chosen.files:
        return 1
    files = selection.read_files(spark, chosen.files).withColumns({"hash": registry.content_hash(F.col("content")), "filename": F.regexp_extract("path", r"([^/]*)$", 1)})
    known = registry.load(spark, tables.registry)
    told = registry.status(files, known, a.force)
    told.groupBy("status").count().show()
    print(f"skipped as of another type: {len(chosen.skipped)}")
    if a.dry_run:
        return 0
    done = written(convert_files(told.where("status <> 'UNCHANGED'")).drop("content"), "converted")
    good = done.where("error IS NULL")
    good.select(F.col("hash").alias("doc_id"), "markdown", "title").write.mode("append").parquet(tables.markdown)
    entries = good.select(F.col("hash").alias("doc_id"), "filename", F.col("path").alias("source_path"), F.col("length").alias("size_bytes"), F.current_timestamp().alias("ingested_at"), "hash")
    registry.save(registry.upsert(known, entries), tables.registry)
    failed = {r["path"]: r["error"] for r in done.where("error IS NOT NULL").select("path", "error").collect()}  # of the files just chosen by name
    for path, error in sorted(failed.items()):
        print(f"failed: {path}: {error}", file=sys.stderr)
    left = {unquote(urlparse(p).path) for p in failed}
    for f in chosen.files:
        if f not in left:  # what failed stays to be tried again
            selection.move_to_processed(f, a.input)
    return 2 if failed else 0


def chunk(spark, a, tables: Tables) -> int:
    """Chunks all documents anew, or with --doc-id one of them: the others' chunks stay."""
    docs = spark.read.parquet(tables.markdown).dropDuplicates(["doc_id"])
    docs = docs.where(F.col("doc_id") == a.doc_id) if a.doc_id else docs
    if docs.isEmpty():
        return 1
    chunks, meta = chunking.chunk_documents(docs)
    store.replace_documents(chunks, tables.chunks)
    store.replace_documents(meta, tables.meta)
    return 0


def embed(spark, a, tables: Tables) -> int:
    """Embeds chunks without a vector; with --force all, or all of --doc-id, whose stored vectors go first."""
    chunks, meta = store.read_chunks(spark, tables.chunks, a.doc_id), store.read_rows(spark, tables.meta)
    have = store.read_rows(spark, tables.vectors)
    rows = written(corpora.embed_chunks(chunks, meta, have, force=a.force), "embedded")
    print(f"{rows.count()} chunks embedded")
    (store.replace_documents if a.force else store.add_rows)(rows, tables.vectors)
    return 0


def config_of(a) -> RetrievalConfig:
    return RetrievalConfig(top_k_broad=a.broad, top_k_final=a.top_k, reranker=a.reranker, max_context_tokens=a.max_tokens, expand_abbreviations=not a.no_expand)


def ask(spark, a, tables: Tables, text: str, answer: bool) -> int:
    queries = spark.createDataFrame([(1, text)], "query_id long, query string")
    corpus = tables.corpus(spark)
    found = retrieve(queries, corpus, config_of(a))
    if answer:
        rows, citations = generate(queries, found, corpus)
        out = rows if a.json else render(rows, citations)
    else:
        out = found.hits.orderBy("rank") if a.no_context else found.windows
    listed = out.toJSON().collect() if a.json else [r[-1] if answer or not a.no_context else r for r in out.collect()]
    print("\n".join(map(str, listed)))
    return 0 if listed else 1


def chat(spark, a, tables: Tables) -> int:
    asked = 0
    for line in iter(lambda: input("> ").strip(), "exit"):
        if line in ("/json", "/text"):
            a.json = line == "/json"
        elif line == "/stats":
            print(f"{asked} questions")
        elif line == "/clear":
            asked = 0
        elif line == "/help":
            print("/json /text /stats /clear /help, exit")
        elif line:
            asked += 1
            ask(spark, a, tables, line, True)
    return 0


def evaluate(spark, a, tables: Tables, answers: bool) -> int:
    golden = store.read_golden(spark, a.golden)
    golden = golden.where(F.col("query_type") == a.type) if a.type else golden
    corpus = tables.corpus(spark)
    queries = golden.select("query_id", "query")
    found = retrieve(queries, corpus, config_of(a))
    if answers:
        rows, citations = generate(queries, found, corpus)
        per, means = evaluation.evaluate_generation(golden, rows, citations)
    else:
        per, means = evaluation.evaluate_retrieval(golden, found.hits)
    metrics.report(means).show(truncate=False)
    if a.output:
        per.write.mode("overwrite").json(a.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrymill", description=__doc__)
    top.add_argument("--root", default="cache")
    subs = top.add_subparsers(dest="command")
    p = subs.add_parser("ingest")
    p.add_argument("paths", nargs="*")
    p.add_argument("--manifest")
    p.add_argument("--input", default="input")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    for name in ("chunk", "embed"):
        p = subs.add_parser(name)
        p.add_argument("--doc-id")
        p.add_argument("--force", action="store_true")
    for name in ("retrieve", "generate", "chat", "evaluate-retrieval", "evaluate-generation"):
        p = subs.add_parser(name)
        if name in ("retrieve", "generate"):
            p.add_argument("query")
        p.add_argument("--top-k", type=int, default=8)
        p.add_argument("--broad", type=int, default=20)
        p.add_argument("--reranker", default="cross-encoder" if name == "evaluate-generation" else "none")
        p.add_argument("--max-tokens", type=int, default=4000)
        p.add_argument("--no-expand", action="store_true")
        p.add_argument("--json", action="store_true")
        p.add_argument("--no-context", action="store_true")
        if name.startswith("evaluate"):
            p.add_argument("--golden", required=True)
            p.add_argument("--type")
            p.add_argument("--output")
    return top


COMMANDS = {
    "ingest": ingest,
    "chunk": chunk,
    "embed": embed,
    "retrieve": lambda s, a, t: ask(s, a, t, a.query, False),
    "generate": lambda s, a, t: ask(s, a, t, a.query, True),
    "chat": chat,
    "evaluate-retrieval": lambda s, a, t: evaluate(s, a, t, False),
    "evaluate-generation": lambda s, a, t: evaluate(s, a, t, True),
}


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if not args or (args[0].startswith("-") and args[0] not in ("-h", "--help", "--root")):
        args = ["ingest", *args]
    elif not args[0].startswith("-") and args[0] not in COMMANDS:
        print(f"unknown command {args[0]!r}", file=sys.stderr)
        return 1
    a = parser().parse_args(args)
    ensure_folders()
    spark = build_session("quarrymill")
    try:
        return COMMANDS[a.command](spark, a, Tables(a.root))
    except Exception as e:  # the command line's answer to any failure
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
