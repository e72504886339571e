import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrymill import cli
from quarrymill.sources import config, registry, selection, store
from quarrymill.sources.providers import convert, filter_elements, html_to_markdown
from quarrymill.streaming.dropfolder import event_windows, ingest_stream


@pytest.fixture
def folder(tmp_path):
    for name in ("a.pdf", "b.DOCX", "c.txt", "sub/d.pdf", "processed/e.pdf"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    return tmp_path


def names(files):
    return sorted(Path(f).name for f in files)


def test_selection_modes(folder, spark):
    found = selection.select_documents(input_dir=str(folder))
    assert found.mode == "folder" and names(found.files) == ["a.pdf", "b.DOCX", "d.pdf"]
    assert names(r.path for r in selection.scan_folder(spark, str(folder)).collect()) == ["a.pdf", "b.DOCX", "d.pdf"]
    manifest = folder / "m.json"
    manifest.write_text(json.dumps({"roots": [str(folder)], "include": ["**/*.pdf", "*.txt"], "exclude": ["sub/*"], "files": [str(folder / "sub/d.pdf"), "missing.pdf"]}))
    found = selection.select_documents(manifest=str(manifest))
    assert found.mode == "manifest" and names(found.files) == ["a.pdf", "e.pdf"] and names(found.skipped) == ["c.txt"] and len(found.warnings) == 1
    found = selection.select_documents([str(folder / "*.pdf"), str(folder / "c.txt"), "nothing.pdf"], str(manifest))
    assert found.mode == "paths" and names(found.files) == ["a.pdf"] and names(found.skipped) == ["c.txt"] and len(found.warnings) == 1
    assert [r.supported for r in found.frame(spark).orderBy("path").collect()] == [True, False]


def test_move_keeps_sub_path(folder):
    (folder / "processed/sub").mkdir()
    (folder / "processed/sub/d.pdf").write_text("old")
    assert selection.move_to_processed(str(folder / "sub/d.pdf"), str(folder)).endswith("processed/sub/d_1.pdf")
    assert selection.move_to_processed(str(folder / "processed/e.pdf"), str(folder)) is None
    assert selection.move_to_processed(__file__, str(folder)) is None


def test_registry_round_trip(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert registry.load(spark, path).count() == 0
    rows = spark.createDataFrame([("h1", "a", "/a", 1, "h1"), ("h2", "b", "/b", 2, "h2")], "doc_id string, filename string, source_path string, size_bytes long, hash string").withColumn("ingested_at", F.current_timestamp())
    registry.save(registry.upsert(registry.load(spark, path), rows), path)
    with open(Path(path) / "part-99999.json", "w") as f:
        f.write('{"doc_id": broken\n{"filename": "no hash"}\n')
    assert {r.hash for r in registry.load(spark, path).collect()} == {"h1", "h2"}
    newer = rows.where("filename = 'a'").withColumns({"hash": F.lit("h3"), "doc_id": F.lit("h3")})
    assert {r.hash for r in registry.upsert(registry.load(spark, path), newer).collect()} == {"h3", "h2"}
    assert [r.status for r in registry.status(newer.select("filename", "hash"), rows).collect()] == ["MODIFIED"]


def test_chunk_store(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d1", "t", [], False), ("c2", "d2", "", ["x"], True)], "chunk_id string, doc_id string, text string, ids array<string>, flag boolean")
    store.write_chunks(chunks, str(tmp_path / "p"), 4)
    assert store.read_chunks(spark, str(tmp_path / "p"), "d2", 4).collect()[0].chunk_id == "c2"
    assert store.read_chunks(spark, str(tmp_path / "p")).count() == 2
    store.write_json(chunks, str(tmp_path / "j"))
    assert sorted(map(tuple, store.read_json(spark, str(tmp_path / "j"), chunks.schema).collect()))[0] == ("c1", "d1", "t", [], False)


def test_golden_file(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps({"_meta": {}, "queries": [{"query": "q", "query_type": "t", "expected_facts": ["f"]}, {"_comment": "x"}]}))
    bad.write_text(json.dumps({"queries": 3}))
    assert [(r.query_id, r.query) for r in store.read_golden(spark, str(good)).collect()] == [(1, "q")]
    with pytest.raises(ValueError):
        store.read_golden(spark, str(bad))


def test_conversion(spark):
    page = "<html><head><title>x</title></head><body><h1>A &amp; B</h1><p>One<br>two</p><ul><li>i</li></ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table></body></html>"
    assert html_to_markdown(page) == "# A & B\n\nOne\ntwo\n\n- i\n\n| h |\n| c |"
    files = spark.createDataFrame([("/x/f.html", page), ("/x/g.html", "no heading"), ("/x/h.html", None)], "path string, content string")
    assert [(r.title, r.error) for r in convert(files).orderBy("path").collect()] == [("A & B", None), ("g", None), ("h", None)]
    failing = convert(files, lambda p: 1 / 0)
    assert failing.where("error is not null").count() == 3
    parts = [("heading", "Table of contents", None, None), ("heading", "ACME GROUP INTERNAL", None, None), ("page_header", "x", None, None), ("table", "| Doc ID | 7 |", None, None), ("picture", "", "logo", None), ("picture", "", None, "A pump"), ("picture", "", None, None), ("text", "kept", None, None)]
    rows = spark.createDataFrame(parts, "kind string, text string, picture_class string, description string")
    assert [r.text for r in filter_elements(rows).collect()] == ["A pump", "[Figure — see source document]", "kept"]


def test_drop_folder_stream(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    seen = []
    run = lambda: ingest_stream(spark, str(folder), str(out / "reg"), str(out / "cp"), lambda d: seen.extend(r.filename for r in d.collect())).awaitTermination()
    run()
    assert sorted(seen) == ["a.pdf", "b.DOCX", "d.pdf"]
    (folder / "f.pdf").write_text("a.pdf")  # a known content
    (folder / "g.pdf").write_text("new")
    run()
    assert sorted(seen) == ["a.pdf", "b.DOCX", "d.pdf", "g.pdf"] and registry.load(spark, str(out / "reg")).count() == 4


def test_event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert event_windows(events).agg(F.sum("n")).first()[0] == events.count()


def test_config(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# c\nQM_A='1'\nexport QM_B=2\nbad\n")
    monkeypatch.delenv("QM_A", raising=False)
    monkeypatch.setenv("QM_B", "kept")
    assert config.load_env(str(env)) == {"QM_A": "1", "QM_B": "2"}
    assert config.require(["QM_A", "QM_B"]) == {"QM_A": "1", "QM_B": "kept"}
    with pytest.raises(KeyError):
        config.require(["QM_NONE"])
    with pytest.raises(KeyError):
        config.provider_config("qm_none", "m")
    monkeypatch.setenv("RAG_CACHE_DIR", str(tmp_path / "cache"))
    assert all(Path(p).is_dir() for p in config.ensure_folders(str(tmp_path)))


def test_command_line(capsys):
    assert cli.main(["nonsense"]) == 1
    assert cli.parser().parse_args(["retrieve", "q", "--top-k", "3"]).top_k == 3
