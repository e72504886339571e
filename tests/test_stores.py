import io
import zipfile
from argparse import Namespace

from quarrymill import cli
from quarrymill.sources import registry, store
from quarrymill.sources.providers import docx_to_markdown

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs):
    body = "".join(f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{s}\"/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in (("Key", "Value"), ("a", "1"))) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}{table}</w:body></w:document>')
    return out.getvalue()


def test_docx():
    got = docx_to_markdown(docx([("Title", "Manual"), ("Heading2", "1.1 Scope"), (None, "It works."), (None, " ")]))
    assert got == "# Manual\n\n## 1.1 Scope\n\nIt works.\n\n| Key | Value |\n|---|---|\n| a | 1 |"


def test_commands_keep_other_documents(spark, tmp_path, monkeypatch):
    """Ingest, chunk and embed; then one document again: nothing of the others is lost, and what failed stays."""
    monkeypatch.chdir(tmp_path)
    folder = tmp_path / "input"
    folder.mkdir()
    for i in range(3):
        (folder / f"d{i}.docx").write_bytes(docx([("Heading1", f"{i + 1} Part"), (None, f"Text number {i} says something of its own. " * 12)]))
    (folder / "bad.pdf").write_bytes(b"%PDF-1.4 no converter")
    (folder / "broken.docx").write_bytes(b"no archive")
    tables = cli.Tables(str(tmp_path / "cache"))
    a = Namespace(paths=[], manifest=None, input=str(folder), force=False, dry_run=False, doc_id=None)
    assert cli.ingest(spark, a, tables) == 2
    assert sorted(p.name for p in folder.iterdir() if p.is_file()) == ["bad.pdf", "broken.docx"]
    assert registry.load(spark, tables.registry).count() == 3
    assert cli.chunk(spark, a, tables) == 0 and cli.embed(spark, a, tables) == 0
    ids = lambda rows, col: sorted(r[0] for r in rows.select(col).collect())
    chunks, vectors, meta = ids(store.read_chunks(spark, tables.chunks), "chunk_id"), ids(store.read_rows(spark, tables.vectors), "chunk_id"), ids(store.read_rows(spark, tables.meta), "doc_id")
    assert len(set(meta)) == 3 and vectors
    one = Namespace(**{**vars(a), "doc_id": meta[0], "force": True})
    assert cli.chunk(spark, one, tables) == 0 and cli.embed(spark, one, tables) == 0
    assert ids(store.read_chunks(spark, tables.chunks), "chunk_id") == chunks
    assert ids(store.read_rows(spark, tables.vectors), "chunk_id") == vectors
    assert ids(store.read_rows(spark, tables.meta), "doc_id") == meta
    assert cli.embed(spark, a, tables) == 0 and ids(store.read_rows(spark, tables.vectors), "chunk_id") == vectors


def test_registry_survives_an_interrupted_save(spark, tmp_path):
    rows = spark.createDataFrame([("a", "f", "p", 1, None, "h")], registry.SCHEMA)
    path = str(tmp_path / "registry")
    registry.save(rows, path)
    registry.save(registry.load(spark, path), path)
    (tmp_path / "registry").rename(tmp_path / "registry.old")
    assert [r.hash for r in registry.load(spark, path).collect()] == ["h"]
