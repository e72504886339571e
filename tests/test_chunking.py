import random

from quarrymill import session
from quarrymill.operators import chunking as k
from quarrymill.operators.structure import parse

MD = """Intro before all
# HwIRS Requirement Specification (DIM Vital) for TOP
# Follow-up of the evolutions
| Revision | Date | What |
|---|---|---|
| A | 2014-01-02 | first |
| B | 2015-03-04 | second |

| APPROVAL | | |
|---|---|---|
| Written by | A. Person | 2016-01-01 |
| Approved by | B. Person | 2016-02-01 |
# 1 Introduction
First para. Second sentence here.

More text.
- item one
  continued
- item two
## 1.1 Abbreviations
| Abbreviation | Meaning |
|---|---|
| ABC | Alpha Beta |

Figure 1: Setup
# 2 Requirements

---

**HW-IRS_DIM_VI_275**

The thing shall work [CD_PAM] with 7HA 02944 AAAA.

[Category: Requirement | Allocation: HW | Priority: Mandatory | Safety: No | Verification: Test]
**Traceability:** [HWADD:TOP:0012] [FVTSR_PAM_0009]

---

**Test case:** FVTR_OPT_01
**Test:** Labelling
**Result:** passed
**Reference:** HW- IRS_DIM_1, STANDARD TEST_X

---
"""


def test_three_tiers(spark):
    docs = spark.createDataFrame([("d1", MD), ("d2", ""), ("d3", "only text")], "doc_id string, markdown string")
    chunks, meta = k.chunk_documents(docs)
    m = {r.doc_id: r for r in meta.collect()}["d1"]
    assert (m.doc_title, m.doc_type, m.module_name, m.system) == ("HwIRS Requirement Specification (DIM Vital) for TOP", "HwIRS", "DIM", "TOP")
    assert (m.revision, m.revision_date, m.authors, m.approvers) == ("B", "2015-03-04", ["A. Person"], ["B. Person"])
    rows = [r for r in chunks.collect() if r.doc_id == "d1"]
    ids = {r.chunk_id for r in rows}
    assert len(ids) == len(rows) and all(r.parent_id in ids for r in rows if r.tier > 1)
    secs = sorted((r for r in rows if r.tier == 2), key=lambda r: r.ord)
    assert [s.heading for s in secs] == ["Front Matter", "1 Introduction", "2 Requirements"]
    assert secs[0].text == "## Front Matter\n- HwIRS Requirement Specification (DIM Vital) for TOP\n- Follow-up of the evolutions"
    assert secs[1].text == "## 1 Introduction\n\nFirst para. Second sentence here.\n\n### 1.1 Abbreviations"
    leaves = {s.heading: sorted((r for r in rows if r.parent_id == s.chunk_id), key=lambda r: r.ord) for s in secs}
    assert [r.chunk_type for r in leaves["Front Matter"]] == ["front_matter"] * 3
    first = leaves["1 Introduction"]
    assert [(r.chunk_type, r.section_path) for r in first] == [("prose", ["1 Introduction"]), ("abbreviation_table", ["1 Introduction", "1.1 Abbreviations"]), ("figure", ["1 Introduction", "1.1 Abbreviations"])]
    assert first[0].text == "First para. Second sentence here.\n\nMore text.\n\n- item one\n  continued\n- item two"  # two small ones joined
    need, test = leaves["2 Requirements"]
    assert need.chunk_type == "requirement" and need.requirement_ids == ["HW-IRS_DIM_VI_275"] and need.component_ids == ["7HA-02944-AAAA"] and need.traceability_ids == ["HWADD:TOP:0012", "FVTSR_PAM_0009"]
    assert need.cross_references == ["CD_PAM", "FVTSR_PAM_0009", "HWADD:TOP:0012"] and need.safety == "No" and not need.is_background
    assert test.chunk_type == "test_case" and test.test_case_id == "FVTR_OPT_01" and test.test_result == "passed" and test.reference_ids == ["HW-IRS_DIM_1", "TEST_X"]
    children = {r.chunk_id: r.children_ids for r in k.children_of(chunks).collect()}
    assert children[secs[2].chunk_id] == [need.chunk_id, test.chunk_id]


def test_blocks_of_shapes(spark):
    md = "# A\ntext\n---\nx\n---\n---\ny\n---\n- l\n  more\nplain\n| a |\n\n| b |\n  loose"
    _, blocks = parse(spark.createDataFrame([("d", md)], "doc_id string, markdown string"))
    got = [(r.block_type, r.text) for r in sorted(blocks.collect(), key=lambda r: r.start_line)]
    assert got == [("prose", "text"), ("atomic_delimited", "x"), ("atomic_delimited", "y"), ("list", "- l\n  more"), ("prose", "plain"), ("table", "| a |"), ("table", "| b |"), ("prose", "loose")]


COUNT = len
CONFIG = k.ChunkConfig(min_tokens=5, max_tokens=20, split_threshold=30, overlap_tokens=4)


def test_merging():
    p, t = "prose", "table"
    items = [(1, p, "aa"), (1, p, "bb"), (1, p, "cc"), (1, p, "long enough"), (1, p, "dd"), (1, t, "|x|"), (2, p, "ee"), (3, p, "ff")]
    assert k.merge_small(items, COUNT, CONFIG) == [(1, p, "aa\n\nbb"), (1, p, "cc\n\nlong enough\n\ndd"), (1, t, "|x|"), (2, p, "ee"), (3, p, "ff")]
    assert k.merge_small([(1, p, "long enough"), (1, p, "dd"), (1, t, "|")], COUNT, CONFIG) == [(1, p, "long enough\n\ndd"), (1, t, "|")]


def test_packing_with_overlap():
    assert k.pack_segments(["a" * 10, "b" * 10, "c" * 10], COUNT, CONFIG) == ["a" * 10 + "\n\n" + "b" * 10, "bbbb\n\n" + "c" * 10]
    assert k.pack_segments(["a" * 18, "bb", "c" * 12], COUNT, CONFIG) == ["a" * 18 + "\n\nbb", "bb\n\n" + "c" * 12]
    assert k.pack_segments(["x" * 15 + "\n" + "y" * 15], COUNT, CONFIG) == ["x" * 15, "xxxx\n\n" + "y" * 15]
    assert k.pack_segments([], COUNT, CONFIG) == [] and k.pack_segments([" "], COUNT, CONFIG) == [" "]


def test_table_pieces():
    head = "|a|\n|-|"
    assert k.split_table(head + "\n|11111111|\n|2222|\n|33|", COUNT, CONFIG) == [head + "\n|11111111|", head + "\n|2222|\n|33|"]
    assert k.split_table("|a|\n|b|", COUNT, CONFIG) == ["|a|\n|b|"]


def test_pieces_hold_every_word():
    rng = random.Random(2)
    for _ in range(200):
        text = "\n\n".join(" ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8)))
        for kind in ("prose", "test_case"):
            pieces = k.pieces_of(kind, text, COUNT, CONFIG)
            assert set(text.split()) <= set(" ".join(pieces).split())


def test_chunking_shuffles_lines_once(spark, monkeypatch):
    """All steps from lines to blocks go by document; sections need headings alone."""
    plans = {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return session.written(df, label)

    monkeypatch.setattr(k, "written", kept)
    docs = spark.createDataFrame([(str(i), f"# 1 One\n\nlead {i}\n\n## 1.1 Two\n\n- item\n\n| a |\n# 2 Three\n---\nx\n---\ny") for i in range(3)], "doc_id string, markdown string")
    chunks, _ = k.chunk_documents(docs)
    assert chunks.where("tier = 3").count() == 3 * 4 and chunks.where("tier = 3 AND heading IS NULL").count() == 0
    assert set(plans) == {"chunk-sections", "chunk-blocks", "chunk-meta"}
    text = [x for x in plans["chunk-blocks"].split("\n") if "Exchange hashpartitioning(" in x]
    assert len(text) == 3 and all("hashpartitioning(doc_id#" in x and x.count("#") <= 3 for x in text)
