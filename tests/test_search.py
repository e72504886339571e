import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import answers, context, lexical, lookup, metrics, queryplan, rerank, vectors
from quarrymill.sources import providers


def test_compound_tokens():
    t = lexical.compound_tokens
    assert t("HW-IRS_DIM_VI_275 thermal protection") == ["hw-irs_dim_vi_275", "hw", "irs", "dim", "vi", "275", "thermal", "protection"]
    assert t("see 7HA 02944 AAAA and HWADD:TOP:0012") == ["7ha 02944 aaaa", "7ha 02944 aaaa", "hwadd:top:0012", "hwadd", "top", "0012", "see", "and"]
    assert t("DIM-NV board") == ["dim-nv", "dim", "nv", "board"]
    assert t("") == [] and t("été") == ["t"]


def test_compound_tokens_take_time_in_proportion():
    """A long run of letters was tried from each of its letters, to its end."""
    run = "a" * 40_000
    began = time.perf_counter()
    assert lexical.compound_tokens(f"{run} _ : -") == [run, "_", "-"]
    assert lexical.compound_tokens(f"é{run} _ : -") == [run, "_", "-"]
    assert time.perf_counter() - began < 2


def test_tokens_column_agrees_with_the_walk(spark):
    texts = ["HW-IRS_DIM_VI_275 x", "plain words only", "DIM-V and co-op", "", "7HA-02944-AAAA", "A_b C_D_1 ABC_D_12", "a:b AB:C", "été-là"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexical.tokens(F.col("t")).alias("k")).collect()
    assert all(r.k == lexical.compound_tokens(r.t) for r in rows)


QUERIES = [
    ("FVTR_OPT_01", "exact_lookup"),
    ("show the FVTR_OPT_01 ?", "exact_lookup"),
    ("HW-IRS_PAM_93 and [HWADD:TOP:0012]", "exact_lookup"),
    ("thermal test of FVTR_OPT_01", "scoped_semantic"),
    ("limits of DIM-VI", "scoped_semantic"),
    ("what does TOP do", "scoped_semantic"),
    ("FVTSR_PAM_0009", "unconstrained"),
    ("insulation voltage", "unconstrained"),
    ("7HA 02944 AAAA", "exact_lookup"),
    ("", "unconstrained"),
]


def test_routing(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(QUERIES)], "query_id long, query string")
    got = {r.query_id: r for r in queryplan.analyse(q).collect()}
    assert [got[i].strategy for i in range(len(QUERIES))] == [s for _, s in QUERIES]
    assert got[4].module_name == "DIM-V" and got[4].remainder == "limits of"
    assert got[5].doc_type is None and got[5].module_name is None and got[5].scoped
    assert got[8].component_ids == ["7HA-02944-AAAA"] and got[8].search_text == "7HA 02944 AAAA"
    assert got[2].cross_references == ["HWADD:TOP:0012"] and got[2].requirement_ids == ["HW-IRS_PAM_93"]


def test_expansion(spark):
    table = spark.createDataFrame([("d1", "ABC", "alpha beta"), ("d2", "ABC", "any big cat"), ("d2", "XY", "ex why")], "doc_id string, acronym string, expansion string")
    q = spark.createDataFrame([(1, "ABC of XY", None), (2, "ABC of XY", "d2"), (3, "none", None)], "query_id long, query string, scope_doc string")
    got = {r.query_id: r.expanded for r in queryplan.expand(q, table, scope_col="scope_doc").collect()}
    assert got == {1: "ABC of XY alpha beta any big cat ex why", 2: "ABC of XY any big cat ex why", 3: "none"}
    assert {r.acronym: r.expansion for r in queryplan.meaning_of(table).collect()} == {"ABC": "alpha beta", "XY": "ex why"}


def test_nearest_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = v.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    plain = q.join(v.select("vec_id", "embedding"), F.lit(True)).select("query_id", "vec_id", F.round(vectors.similarity(vectors.cosine(F.col("vector"), F.col("embedding"))), 6).alias("s"))
    want = {}
    for r in plain.collect():
        want.setdefault(r.query_id, []).append((-r.s, r.vec_id))
    got = {}
    for r in vectors.nearest(q, v, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 6), r.vec_id))
    for i, found in got.items():
        assert [x[1:] for x in sorted(found)] == sorted(want[i])[:5]


def test_nearest_shuffles_no_vector(spark, monkeypatch):
    for name, n in (("CANDIDATE_BLOCK", 7), ("QUERY_BLOCK", 2), ("QUERY_SLICE", 3)):
        monkeypatch.setattr(vectors, name, n)
    rows = [(i, [float(i % 7), float(i % 3) - 1, 1.0][: 2 + i % 2], "ab"[i % 2] if i % 9 else None) for i in range(70)] + [(70, [0.0, 0.0], "a"), (71, None, "a")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4)
    q = v.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")

    def cos(a, b):
        x, y = ([*u, 0.0][:3] for u in (a, b))
        size = sum(e * e for e in x) ** 0.5 * sum(e * e for e in y) ** 0.5
        return round(sum(e * f for e, f in zip(x, y, strict=True)) / size, 9) if size else 0.0

    got = vectors.nearest(q, v, 5, scope=[("label", "label")])
    want = {(i, n + 1, c) for i, a, s in rows[:10] for n, (_, c) in enumerate(sorted((-cos(a, b), j) for j, b, t in rows if b and s and s == t)[:5])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_lookup_pairs_are_never_shuffled(spark, monkeypatch):
    """Every pair once, whatever the blocks, and from an exchange no more rows than rows and queries in."""
    monkeypatch.setattr(lookup, "ROW_BLOCK", 16)
    monkeypatch.setattr(lookup, "QUERY_BLOCK", 8)
    rows = [(i, "ab"[i % 2], "k; B" if i % 3 else "k", "Red ant" if i % 5 else "blue") for i in range(200)] + [(1, "a", "k", "x"), (2, None, None, None)]
    store = spark.createDataFrame(rows, "id long, brand string, kinds string, text string")
    asks = [(q, v) for q in range(60) for v in ("a", "b", "K", "k", "red", "u") if (q + len(v)) % 4] + [(1, None), (1, "a")]
    wanted = spark.createDataFrame(asks, "query_id long, value string")
    whole = {k for _, _, k, _ in rows}
    fits = {
        "test_case": lambda v, r: v == r[1],
        "requirement": lambda v, r: r[2] is not None and (v == r[2] or v not in whole and v.lower() in [p.strip().lower() for p in r[2].split(";")]),
        "component": lambda v, r: r[3] is not None and v.lower() in r[3].lower(),
    }
    for kinds in ([k] for k in fits), [list(fits)]:
        for some in kinds:
            got = lookup.exact_lookup(dict.fromkeys(some, wanted), store, ["id"], columns={"test_case": "brand", "requirement": "kinds"})
            want = {(q, r[0], 1.0) for q, v in asks if v for r in rows if any(fits[k](v, r) for k in some)}
            found = [tuple(x) for x in got.collect()]
            assert len(found) == len(set(found)) and set(found) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan.split("Join")[0] and not any(x in plan.split("Join")[0] for x in ("Aggregate", "Sort", "Repartition"))


def test_bm25_in_small_blocks_shuffles_hits_alone(spark, monkeypatch):
    for name, n in (("CHUNK_BLOCK", 7), ("QUERY_BLOCK", 3), ("QUERY_SLICE", 5)):
        monkeypatch.setattr(lexical, name, n)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "rare", "the"]
    lines = [(i, " ".join(rng.choice(words[:4] + ["the"] * 4) for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(150, "rare rare"), (151, "")]
    chunks = spark.createDataFrame(lines, "id long, text string").repartition(5)
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(12)], "query_id long, text string")
    index = lexical.indexed(chunks, ["id"], tokenizer=lexical.plain_tokens)
    every = lexical.bm25_scores(queries, index, ["id"], tokenizer=lexical.plain_tokens).where("score > 0").collect()
    want = {(r.query_id, n + 1, r.id) for q in range(12) for n, r in enumerate(sorted((r for r in every if r.query_id == q), key=lambda r: (-round(r.score, 9), r.id))[:4])}
    top = lexical.bm25_top(queries, index, ["id"], 4, tokenizer=lexical.plain_tokens)
    assert {(r.query_id, r["rank"], r.id) for r in top.collect()} == want
    assert "MapInArrow" in (plan := top._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan and "Join" not in plan
    stats = lexical.index_stats(index).first()
    assert (stats.n_chunks, stats.n_tokens) == (sum(bool(t) for _, t in lines), 6)
    odd = ["Été-là 1_a  B", "", None, "x\ty--\n", "漢字", "ſ K z"]
    split = lexical._token_lists(lexical.indexed(spark.createDataFrame([(t,) for t in odd], "text string"), [], tokenizer=lexical.plain_tokens).toArrow().column("tokens").combine_chunks())
    want = [r.t or [] for r in spark.createDataFrame([(t,) for t in odd], "text string").select(lexical.plain_tokens(F.col("text")).alias("t")).collect()]
    assert [[t for i, t in zip(split[0], split[1].to_pylist(), strict=True) if i == n] for n in range(len(odd))] == want
    none = lexical.indexed(chunks.where("false"), ["id"])
    assert lexical.bm25_top(queries, none, ["id"]).count() == 0 and lexical.index_stats(none).first().n_chunks == 0


def test_rerankers(spark):
    hits = spark.createDataFrame([(1, 1, 5.0), (1, 2, 9.0), (1, 3, 9.0), (2, 1, 4.0), (2, 2, 4.0)], "query_id long, rank int, raw double")
    got = [(r.query_id, r["rank"], r.score) for r in rerank.min_max(hits, 2).orderBy("query_id", "new_rank").collect()]
    assert got == [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert [r.score for r in rerank.clamped(hits.withColumn("raw", F.col("raw") * 3 - 10), 3).orderBy("query_id", "new_rank").collect()] == [1.0, 1.0, 0.5, 0.2, 0.2]
    replies = spark.createDataFrame([(1, 'so: [{"index": 0, "score": 7}, {"index": 2, "score": 3.5}] ok'), (2, "none")], "query_id long, reply string")
    assert sorted(map(tuple, rerank.judged_scores(replies).collect())) == [(1, 0, 7.0), (1, 2, 3.5)]
    assert rerank.reranker(" Cross_Encoder ") is rerank.min_max
    with pytest.raises(ValueError):
        rerank.reranker("other")


SUPPORT = [(0.90, 1.0), (0.85, 1.0), (0.84, 0.85), (0.75, 0.85), (0.70, 0.65), (0.65, 0.65), (0.64, 0.4), (None, 0.4)]


def test_support_thresholds(spark):
    cols = "query_id long, best_vector double, strategy string, model_confidence string, citation_coverage_ratio double, all_citations_resolved boolean, abstention_consistent boolean, contains_unmapped_citations boolean"
    rows = [(i, b, "unconstrained", "HIGH", 1.0, True, True, False) for i, (b, _) in enumerate(SUPPORT)]
    rows += [(100, 0.1, "exact_lookup", "HIGH", 1.0, True, True, False), (101, 0.9, "", "MEDIUM", 1.0, True, True, False), (102, 0.9, "", "HIGH", 0.5, True, True, False), (103, 0.9, "", "HIGH", 1.0, False, True, True), (104, 0.9, "", "odd", 1.0, True, True, False)]
    got = {r.query_id: r for r in answers.confidence(spark.createDataFrame(rows, cols)).collect()}
    assert [got[i].retrieval_support for i in range(len(SUPPORT))] == [s for _, s in SUPPORT]
    assert [got[i].final_level for i in range(8)] == ["HIGH"] * 4 + ["MEDIUM"] * 2 + ["LOW"] * 2
    assert {i: got[i].final_level for i in range(100, 105)} == {100: "HIGH", 101: "MEDIUM", 102: "MEDIUM", 103: "LOW", 104: "LOW"}


def test_verification_variants(spark):
    responses = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False), (5, False), (6, True)], "query_id long, abstained boolean")
    claims = spark.createDataFrame([(1, 0, [1]), (1, 1, [2]), (3, 0, [1]), (3, 1, []), (4, 0, [1]), (4, 1, [99, 98]), (6, 0, [1])], "query_id long, claim_index int, source_ids array<int>")
    valid = spark.createDataFrame([(q, s) for q in range(1, 7) for s in (1, 2, 3)], "query_id long, source_id int")
    got = {r.query_id: r for r in answers.verify(responses, claims, valid).collect()}
    assert got[1].all_citations_resolved and got[1].all_claims_cited and got[1].abstention_consistent and got[1].citation_coverage_ratio == 1
    assert got[2].abstention_consistent and got[2].citation_coverage_ratio == 1
    assert not got[3].all_claims_cited and got[3].uncited_claim_indices == [1] and got[3].citation_coverage_ratio == 0.5
    assert got[4].contains_unmapped_citations and got[4].unmapped_source_ids == [99, 98] and got[4].citation_coverage_ratio == 1
    assert not got[5].abstention_consistent and not got[6].abstention_consistent


def test_metric_edges(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "query_id long, query_type string")
    got = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "query_id long, item_id string, rank int")
    rel = spark.createDataFrame([(1, "y"), (1, "w"), (3, "q")], "query_id long, item_id string")
    m = {r.query_id: r for r in metrics.retrieval_metrics(q, got, rel).collect()}
    assert (m[1].precision, m[1].recall, m[1].reciprocal_rank, m[1].hit) == (0.5, 0.5, 0.5, 1.0)
    assert abs(m[1].ndcg - (1 / 1.5849625) / (1 + 1 / 1.5849625)) < 1e-6
    assert (m[2].precision, m[2].recall, m[2].ndcg) == (0.0, 1.0, 1.0)
    assert (m[3].precision, m[3].recall, m[3].ndcg, m[3].hit) == (0.0, 0.0, 0.0, 0.0)
    assert (m[4].precision, m[4].recall, m[4].ndcg) == (0.0, 1.0, 1.0)


def test_relevance_by_another_column_is_not_repeated_for_each_query(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "query_id long, label string")
    got = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1), (3, "x", 1), (4, "x", 1)], "query_id long, item_id string, rank int")
    rel = spark.createDataFrame([("a", "y"), ("a", "w"), ("a", "w"), ("b", "x")], "label string, item_id string")
    plain = metrics.retrieval_metrics(q, got, q.join(rel, "label").select("query_id", "item_id"))
    by = metrics.retrieval_metrics(q, got, rel, by="label")
    assert sorted(map(str, by.collect())) == sorted(map(str, plain.collect()))
    relations = by._jdf.queryExecution().optimizedPlan().toString()
    assert relations.count("LogicalRDD") + relations.count("LocalRelation") == plain._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") - 1


def test_sections_move_texts_twice(spark):
    """A text joins its hit and its section; ranks, places and leads are found without it."""
    rows = [("d", i, f"c{i}", "s", "table" if i % 2 else "prose", f"text {i}", 3, False, False, None, None) for i in range(6)]
    rows += [("d", 0, "s", None, "section", "Head", 2, False, False, "Head", "1")]
    chunks = spark.createDataFrame(rows, "doc_id string, ord int, chunk_id string, parent_id string, chunk_type string, text string, tier int, has_table boolean, has_figure boolean, heading string, section_number string")
    hits = spark.createDataFrame([(1, "c1", 0.5, 1), (1, "c3", 0.4, 2), (1, "s", 0.3, 3), (2, "c2", 0.9, 1), (2, "none", 0.1, 2)], "query_id long, chunk_id string, score double, rank int")
    made = context.group_sections(hits, chunks)
    got = {(r.query_id, r.parent_key): ([c.chunk_id for c in r.children], r.lead_ids, r.preamble, r.position, r.section_heading) for r in made.collect()}
    assert got == {
        (1, "s"): (["s", "c1", "c3"], ["c0", "c2"], "text 0\n\ntext 2", 1, "Head"), (2, "s"): (["c2"], [], "", 1, "Head"), (2, "none"): (["none"], [], "", 2, ""),
    }
    for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "Window" not in line or "text" not in line.split("Window")[1]


def test_budget_matches_greedy_rule(spark):
    rng = random.Random(3)
    rows = [(q, p, rng.randint(0, 60)) for q in range(40) for p in range(1, rng.randint(2, 9))]
    df = spark.createDataFrame(rows, "query_id long, position int, token_count int")
    got = {(r.query_id, r.position) for r in context.within_budget(df, 100).collect()}
    want = set()
    for q in range(40):
        used = 0
        for _, p, t in sorted(r for r in rows if r[0] == q):
            if used + t > 100 and p > 1:
                break
            used += t
            want.add((q, p))
    assert got == want


def test_retries_and_models():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    waits = []
    assert providers.with_retries(flaky, 3, 2.0, waits.append)() == "up" and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        providers.with_retries(lambda: 1 / 0, 2, 0, waits.append)()
    reply = json.loads(providers.ExtractiveModel()("", "CONTEXT\n\n### One  [FVTR]\n\nFirst fact. More.\n\nQUESTION\n\nq"))
    assert reply["claims"] == [{"statement": "First fact.", "source_ids": [1]}] and not reply["abstained"]
    assert set(reply) == set(answers.response_schema()["json_schema"]["schema"]["required"])
    near = providers.HashEmbedder(64)
    a, b, c = near(["alpha beta gamma", "alpha beta delta", "quite other words"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > dot(a, c)
