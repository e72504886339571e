import random
import zlib
from collections import Counter, defaultdict

import pytest

from quarrymill.llm.sharding import assign_shards, schedule, write_shards


def brute(rows, shards):
    """Every group by itself, least-loaded shard found by search."""
    size = defaultdict(int)
    for _, text in rows:
        size[text or ""] += len((text or "").encode()) + 16
    load = [0] * shards
    import hashlib

    for text, n in sorted(size.items(), key=lambda x: (-x[1], hashlib.md5(x[0].encode()).hexdigest())):
        load[load.index(min(load))] += n
    return sorted(load)


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    home = defaultdict(set)
    text_of = defaultdict(set)
    for d, t in rows:
        text_of[d].add(t or "")
    for r in got:
        if len(text_of[r.doc_id]) == 1:
            home[next(iter(text_of[r.doc_id]))].add(r.shard)
    assert all(len(x) == 1 for x in home.values())
    return sorted([sum(r.size for r in own) for own in by.values()] + [0] * (shards - len(by)))


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(rows, assign_shards(docs, 40).collect(), 40) == brute(rows, 40)


def test_larger_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(rows, assign_shards(docs.repartition(7), 4).collect(), 4) == brute(rows, 4)


def test_many_groups_of_one_size(spark):
    rows = [(i, f"{i:06d}") for i in range(3000)] + [(9000 + i, "copies " * 9) for i in range(500)] + [(8000 + i, f"{i:03d}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check(rows, assign_shards(docs, 7).collect(), 7) == brute(rows, 7)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 500_000), (4, "é"), (4, "é"), (None, "é"), (None, None), (5, "b"), (6, "b")]
    docs = spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id long, text string, Shard int, slot string")
    check(rows, assign_shards(docs, 3).collect(), 3)
    check(rows, assign_shards(docs, 1).collect(), 1)
    assert assign_shards(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        assign_shards(docs, 0)


def test_schedule_by_runs():
    """Dealing a run at once gives each shard as many as dealing its items one by one."""
    rng = random.Random(5)
    for _ in range(200):
        shards = rng.randint(1, 6)
        runs = list({rng.randint(1, 40): rng.randint(1, 90) for _ in range(rng.randint(0, 12))}.items())
        load = [0] * shards
        for size, count, (got, to, upto) in zip(*map(list, zip(*sorted(runs, reverse=True), strict=True)), schedule(runs, shards), strict=True) if runs else []:
            want = [0] * shards
            for _ in range(count):
                s = load.index(min(load))
                load[s] += size
                want[s] += 1
            assert got == size and upto[-1] == count
            assert {s: n for s, n in enumerate(want) if n} == {s: b - a for s, a, b in zip(to, [0, *upto], upto, strict=False)}


def test_writes_folders(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5
