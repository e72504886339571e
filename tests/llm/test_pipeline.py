from collections import defaultdict

import pytest

import corpus_pipeline
from quarrymill.llm.common import materialize
from quarrymill.llm.quality import counts


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_columns_and_ids(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == stages[0].columns
        assert set(texts(after)) <= set(texts(before)) and after.count() > 0
        assert all(r.n_chars == len(r.text) for r in after.collect())


def test_quality_stage(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert all(before[d] == t for d, t in after.items())
    for d, t in before.items():
        n, *_, rep = counts(t)[:5]
        if n < 50 or rep * 2 > n:
            assert d not in after
        elif labels.get(d) == 1:
            assert d in after


def test_near_duplicate_stage(stages):
    """By all pairs: five-word shingles, similarity 0.8 or more; the smallest id of each group stays."""
    from test_simhash import brute_copies

    before, after = texts(stages[1]), texts(stages[2])
    rows = sorted(before.items())
    want = {rows[root][0] for root in brute_copies(rows)}
    assert len(want) < len(before)
    assert set(after) == want and all(before[d] == t for d, t in after.items())


def test_passage_stage_leaves_no_exact_passage(stages):
    from test_substring import brute_exact

    before, after = texts(stages[2]), texts(stages[3])
    hit = brute_exact(before.items())
    assert not brute_exact(after.items())
    assert all(after.get(d) == t for d, t in before.items() if d not in hit and d in after and len(after[d]) == len(t))
    assert all(d in hit or len(t.split()) >= 50 for d, t in before.items() if after.get(d) != t)


def test_mix_and_pack_stages(stages):
    mixed = texts(stages[4])
    before = texts(stages[3])
    assert all(before[d] == t for d, t in mixed.items())
    pieces = defaultdict(int)
    for r in stages[5].collect():
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(mixed)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    cols = ["doc_id", "start", "length", "ids", "doc_tokens"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, stages[-1].select(*cols).collect()))
