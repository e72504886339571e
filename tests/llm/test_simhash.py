import random
import re

import numpy as np
import pytest
import xxhash

from quarrymill.llm.common import materialize
from quarrymill.llm.simhash import drop_near_duplicates, near_copies, near_duplicates, rarest_shingles, word_sketches


def brute(rows):
    """Bit counting and all pairs, in plain Python."""
    fps = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, ((d, _), fp) in enumerate(zip(rows, fps, strict=True))), key=str)


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(9, None), (3, ""), (4, " \n\t"), (5, "One"), (6, "one"), (6, "one"), (7, "a b"), (None, "one"), (8, long), (10, long + " tail"), (11, "é É x y")]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, fp string, Component_ID int")
    got = near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # 10 differs from 8 by one shingle
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([9, 3, 4, 5, 7, None, 8, 11], key=str)
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


@pytest.mark.parametrize("bits", [0, 2])
def test_thresholds_nest(spark, sf_dir, bits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = near_duplicates(docs, max_bits=bits).select("component_id").distinct().count()
    assert few >= near_duplicates(docs).select("component_id").distinct().count()


def template_copies(rng, n, length=120, changes=3):
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    rows = []
    for i in range(n):
        own = base[:]
        for j in rng.sample(range(length), changes):
            own[j] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def components(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in near(i):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_large_group_of_near_copies(spark):
    rows = template_copies(random.Random(4), 2500) + [(2500 + i, t) for i, t in template_copies(random.Random(5), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_duplicates(docs).collect()}
    fp = np.array([got[i][0] for i in range(len(rows))], np.uint64)
    want = components(len(rows), lambda i: np.flatnonzero(np.bitwise_count(fp[i] ^ fp[:i]) <= 3))
    assert [got[i][1] for i in range(len(rows))] == want
    assert max(map(want.count, set(want))) > 500


def shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_copies(rows, least=0.8):
    sets = [shingles(t or "") for _, t in rows]
    similar = lambda i: [j for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return components(len(rows), similar)


def test_near_copies_against_brute_force(spark):
    """Every link found is one, and nine of ten copies with a few changed words are found; all where copies are many."""
    rng = random.Random(6)
    rows = []
    for _ in range(150):  # pairs at similarity 0.8 to 1
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        own = base[:]
        for j in rng.sample(range(len(own)), max(1, round(len(own) * rng.choice((0.005, 0.01, 0.02))))):
            own[j] = "changed"
        rows += [" ".join(base), " ".join(own)]
    rows += [t for _, t in template_copies(rng, 200)]
    rows = list(enumerate(rows))
    want = brute_copies(rows)
    got = {r.id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in range(300) if want[i] != i]
    assert len(linked) > 120
    assert all(got[i] == i or want[got[i]] == want[i] for i in range(len(rows)))
    assert sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert [got[i] for i in range(300, 500)] == want[300:]


def test_sketches_count_words_once():
    a, b = word_sketches(["one two three", "three ONE two one one"])
    assert a.tolist() == b.tolist()
    assert word_sketches([None, "", " "]).tolist() == [[0, 0, 0]] * 3


def test_unlinked_copies_of_a_template_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Most copies here have too many changes to link with any other; they share segments all the same."""
    from quarrymill.llm import simhash

    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(600):
        own = base[:]
        for j in rng.sample(range(150), 1 + i % 8):
            own[j] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    compared = []

    def counted(df, label):
        out = materialize(df, label)
        if label == "copies-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    got = {r.id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_copies(rows)
    assert len(set(want)) > 200 and max(map(want.count, set(want))) > 75
    assert [got[i] for i in range(600)] == want
    assert sum(compared) < 40 * len(rows)


def test_rarest_shingles_keep_every_similar_pair(spark):
    rng = random.Random(8)
    sets = []
    for i in range(120):
        own = set(rng.sample(range(60), rng.randint(1, 12)))
        sets.append((i, sorted(own)))
        sets += [(1000 * k + i, sorted(set(rng.sample(sorted(own), max(1, len(own) - 1))) | set(rng.sample(range(60), k - 1)))) for k in (1, 2)]
    got = rarest_shingles(spark.createDataFrame(sets, "node long, shingles array<long>"), 0.8).collect()
    keys = {}
    for r in got:
        keys.setdefault(r.node, {})[r.key] = (r.size, r.at)
    similar = [(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))]
    assert len(similar) > 100
    for a, b in similar:
        common = keys[a].keys() & keys[b].keys()
        assert any(1.8 * min(n - i, m - j) >= 0.8 * (n + m) - 1e-6 for (n, i), (m, j) in ((keys[a][k], keys[b][k]) for k in common))
