import re

import numpy as np

from quarrymill.llm import quality
from quarrymill.llm.quality import COUNTS, FEATURES, chi2_quantile, counts, judge, keep_good


def plain_counts(text):
    """The contract's words, read letter by letter."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked))


def test_counts_match_plain_rules(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 6000]
    texts += [None, "", " \n\t", "a", "a b c", "a b c a b c", "x y z w x y z", "é # | <b>\n\n\nq\nq\nq ", "a b\x85c d\x1fe", "l\r\nl\r\nl", "r " * 300]
    for t in texts:
        assert counts(t)[:5] == plain_counts(t), t


def test_chi_square_quantiles():
    assert abs(chi2_quantile(0.5, 6) - 5.34812) < 1e-4
    assert abs(chi2_quantile(0.99, 6) - 16.8119) < 1e-3


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0 and r.toxic == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_estimates_match_numpy(spark):
    rng = np.random.default_rng(5)
    p = len(FEATURES)
    x = rng.normal(size=(3000, p)) * np.arange(1, p + 1) + 3
    x[:600] += 60
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"f{i} double" for i in range(p)))
    model = quality.mcd_models(rows, [0.01] * p, steps=5).first()
    clean = x[600:]
    assert np.allclose(model.center, clean.mean(0), atol=0.6)
    cov = np.linalg.inv(np.array(model.inverse).reshape(p, p))
    assert np.all(np.abs(np.diag(cov) / clean.var(0) - 1) < 0.5)


def test_edges(spark):
    rng = np.random.default_rng(3)
    long = " ".join("".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (50_000, 2)))
    fine = "\n".join(" ".join(f"{a}{b}" for b in "bcdfghjklm") for a in "aeiou" for _ in [0]) + " tail of the text goes on here for a while"
    rows = [(i, fine + f" n{i}", "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (102, "!!! ### " * 40, "en", "s"), (103, fine, None, "s"), (None, fine + " $$$", "en", "s"), (103, fine, None, "s")]
    rows += [(104, long, "en", "s"), (105, " ".join(f"#w{i}!!" for i in range(80)), "en", "s")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, source string, N_WORDS int, kept boolean")
    got = {(r.doc_id, r.n_words): r.kept for r in judge(docs).select("doc_id", "n_words", "kept").collect()}
    assert not got[100, 0] and not got[101, 0] and not got[102, 80] and not got[105, 80]
    assert got[104, 50_000] and all(got[i, 61] for i in range(60))
    assert got[103, 60]  # a group too small for an estimate
    out = keep_good(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 103").count() == 2 and out.where("doc_id is null").count() == 1
    assert judge(docs.limit(0)).count() == 0 and keep_good(docs.limit(0)).count() == 0
    assert set(COUNTS) <= set(judge(docs).columns)
