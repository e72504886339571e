import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm.packing import Packer, pack, tokenize

TOKENIZER = path("byte_bpe_50k.json")


def reference(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, expected, window=2048):
    """The exact round trip: pieces give back every document, sequences have no gap and no padding."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == own[0].sequence_length <= window and at & (at - 1) == 0
        assert len({r.step_group for r in own}) == 1
    for doc, ids in expected.items():
        own = sorted(docs.pop(doc), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) for r in own)
    assert not docs
    return seqs


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seqs = check(pack(docs, TOKENIZER).collect(), dict(zip(texts, reference(texts.values()), strict=True)))
    short = sum(own[0].sequence_length < 256 for own in seqs.values())
    assert short <= 8 * docs.rdd.getNumPartitions()
    load = defaultdict(int)
    for own in seqs.values():
        load[own[0].step_group] += own[0].sequence_length
    assert sorted(load.values())[len(load) // 2] == 8 * 2048


def test_contract_digest(spark, sf_dir):
    from quarrymill.llm.queries import QUERIES

    rows = QUERIES["op5_hierarchical_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = dict(zip(texts, reference(texts.values()), strict=True))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_odd_texts_tokenize_alike():
    texts = ["", " ", "\n\n \t x", "<|endoftext|>", "<|endoftext|>x", "a  <|endoftext|>\n b<|endoftext|><|endoftext|> ", "<|endoftext", "a" * 5000, " " * 5000 + "x", "é" * 999, "日本語 テスト 🙂", "\x00\x85 \xa0z", "don't I'LL 12345 $$$"]
    assert [tokenize(t, TOKENIZER).tolist() for t in texts] == reference(texts)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "x"), (5, "x")]
    docs = spark.createDataFrame([(*r, 1, b"q") for r in rows], "doc_id long, text string, Length int, ids binary")
    check(pack(docs, TOKENIZER).collect(), {d: i for (d, _), i in zip(rows, reference([t for _, t in rows]), strict=True)})
    again = pack(docs.union(docs).withColumn("doc_id", F.lit(None).cast("long")), TOKENIZER)
    assert again.agg(F.sum("length")).first()[0] == 2 * sum(map(len, reference([t for _, t in rows])))
    assert pack(docs.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        pack(docs, TOKENIZER, (100,))


def test_packer_with_small_pools():
    rng = random.Random(8)
    for _ in range(50):
        packer, total, rows = Packer((4, 8, 32), 0), 0, []
        for d in range(rng.randint(0, 40)):
            ids = np.arange(rng.randint(1, 100), dtype=np.uint32)
            total += len(ids)
            packer.add(d, ids)
            if rng.random() < 0.2:
                packer.pack(16)
                rows += packer.drain(False)
        packer.finish()
        rows += packer.drain(True)
        assert sum(r[2] for r in rows) == total and not packer.docs and not packer.waiting
        assert len({(r[0], r[1]) for r in rows}) == len(rows)
