from collections import defaultdict

from pyspark.sql import functions as F

from quarrymill.llm.mixing import mix, rake, sample_mix


def test_raking_reaches_every_marginal(spark):
    cells = spark.createDataFrame([("a", "x", "t", 50.0), ("a", "y", "t", 10.0), ("b", "x", "u", 25.0), ("b", "y", "t", 15.0), ("a", "x", "u", 5.0)], "source string, lang string, topic string, w double")
    goals = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 3, "y": 1, "absent": 9}, "topic": {"t": 0.5, "u": 0.5}}
    rows = rake(cells, "w", goals, rounds=60).collect()
    for dim, want in (("source", {"a": 0.4, "b": 0.6}), ("lang", {"x": 0.75, "y": 0.25}), ("topic", {"t": 0.5, "u": 0.5})):
        got = defaultdict(float)
        for r in rows:
            got[r[dim]] += r.raked
        assert all(abs(got[k] - v) < 1e-6 for k, v in want.items()), (dim, dict(got))


def test_matches_plain_ipf(spark, sf_dir):
    """Iterative proportional fitting in plain Python over the same cells."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs).collect()
    w = defaultdict(float)
    for r in rows:
        w[r.source, r.lang, r.topic] += r.tokens
    total = sum(w.values())
    share = {k: v / total for k, v in w.items()}
    goals = []
    for d in range(3):
        sums = defaultdict(float)
        for k, v in share.items():
            sums[k[d]] += v
        powered = {k: v**0.85 for k, v in sums.items()}
        goals.append({k: v / sum(powered.values()) for k, v in powered.items()})
    cur = dict(share)
    for _ in range(10):
        for d in range(3):
            sums = defaultdict(float)
            for k, v in cur.items():
                sums[k[d]] += v
            cur = {k: v * goals[d][k[d]] / sums[k[d]] for k, v in cur.items()}
    ratio = {k: cur[k] / share[k] for k in cur}
    top = max(ratio.values())
    assert all(abs(r.probability - ratio[r.source, r.lang, r.topic] / top) < 1e-9 for r in rows)


def test_sample_follows_targets(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit("en").alias("lang"), F.lit("word " * 20).alias("text")
    )
    goal = {"hot": 1, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1}
    got = {r.source: r["count"] for r in sample_mix(docs, {"source": goal}).groupBy("source").count().collect()}
    assert set(got) == set(goal) and max(got.values()) < 1.1 * min(got.values())
    marked = mix(docs, {"source": goal})
    assert marked.count() == 20_000 and marked.where("sampled").count() == sum(got.values())


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "x " * 400_000, "en", "a"), (4, "text", "en", "a"), (4, "text", "en", "a"), (None, "text", None, "b")]
    docs = spark.createDataFrame([(*r, 2, "c", 0.5) for r in rows], "doc_id long, text string, lang string, source string, Tokens int, mix_cell string, u double")
    got = mix(docs).collect()
    assert len(got) == 6 and all(0 <= r.probability <= 1 for r in got)
    assert all(r.sampled and r.probability == 1 for r in got if r.doc_id in (1, 2))
    out = sample_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.sampled for r in got)
    assert mix(docs.limit(0)).count() == 0 and sample_mix(docs.limit(0)).count() == 0
    none = mix(docs, {"source": {"b": 1.0}})
    assert not any(r.sampled for r in none.where("source = 'a' and tokens > 0").collect())
