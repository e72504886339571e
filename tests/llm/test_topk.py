import math

import numpy as np

from quarrymill.llm.topk import SortedLists, top_k


def brute(rows, k=20, step=20):
    ok = sorted({(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, a in ok:
        if q % step == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_matches_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert sorted(map(tuple, top_k(vectors).collect())) == brute(rows)


def test_small_blocks_and_hot_vector(spark, monkeypatch):
    from quarrymill.llm import topk

    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, -0.5, 0.25] if i % 3 == 0 else rng.normal(size=3).round(1).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [None, 1.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0]), (120, [0.0, 0.0]), (140, [1.0]), (5, [2.0])]
    vectors = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, Score int, rank double")
    assert sorted(map(tuple, top_k(vectors).collect())) == brute(rows)
    assert top_k(vectors.limit(0)).count() == 0


def test_reading_stops_early():
    """Near neighbours in a crowd of clusters are told apart before the lists end."""
    rng = np.random.default_rng(1)
    centers = 8 * rng.normal(size=(40, 8))
    x = np.floor(centers[rng.integers(0, 40, 6000)] * 8 + rng.normal(size=(6000, 8))).astype(np.float64)
    lists = SortedLists(x)
    found = lists.best(x[:50], 20)
    for q, (at, scores) in zip(x[:50], found, strict=True):
        exact = x @ q
        least = np.sort(exact)[-20]
        assert sorted(at.tolist()) == np.flatnonzero(exact >= least).tolist() and (scores == exact[at]).all()
    assert np.mean(lists.shares_read) < 0.9


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(0, rng.normal(size=3).tolist()), (0, rng.normal(size=3).tolist())] + [(i, rng.normal(size=3).tolist()) for i in range(1, 40)]
    rows += [(40, v) for v in rng.normal(size=(60, 3)).tolist()] + [(41, rows[0][1]), (60, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(vectors).collect()))
    assert got == brute(rows)
    assert sum(r[0] == 0 for r in got) == 40


def test_components_beyond_floating_point(spark):
    rows = [(0, [1e14, 1.0]), (1, [1e14, 1.5]), (2, [-1e14, 3.0]), (3, [1e300, 1.0]), (4, [0.0, -2.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    exact = 64 * 10**14 * 64 * 10**14 + 64 * 96
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == [(0, 1, 1, hold(exact)), (0, 2, 4, -128 * 64), (0, 3, 2, hold(-(64 * 10**14) ** 2 + 64 * 192))]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = np.floor(64 * rng.normal(size=(700, 9)))
    q = np.floor(64 * rng.normal(size=(30, 9)))
    lists, exact = SortedLists(x), x @ q.T
    for share in (0.05, 0.2, 0.5, 0.8, 1.0):
        low, high = lists.bounds(q, share)
        assert (low <= exact + 1e-6).all() and (high >= exact - 1e-6).all()
