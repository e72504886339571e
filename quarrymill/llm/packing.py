"""Hierarchical packing of tokenized documents into sequences of several context sizes."""

from __future__ import annotations

import json
import sys
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import text_or_empty

END_ID = 1
#: Tokens kept waiting for a better place, and sequences dealt to step groups at once: both bound a task's memory.
POOL_TOKENS = 1_000_000
STEP_WINDOWS = 8


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a byte-level BPE file in the format of the library `tokenizers`, run by tiktoken.

    The ids are the same (tested over whole tables); tiktoken takes about a fifth of the CPU time.
    The contents of added tokens become their ids wherever a text holds them, as that library does by default.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    added = found.get("added_tokens", [])
    if found.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("normalizers and added tokens that take their surroundings are not supported")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenize(text: str, path: str) -> np.ndarray:
    """The whole text's ids and the end id."""
    ids = encoder(path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids.astype(np.uint32, copy=False), np.uint32(END_ID))


class Packer:
    """Packs one partition's documents; every sequence is full, and only the last few are shorter than a tier.

    A document's whole windows of the largest size are sequences of their own.  What remains is routed to the
    smallest tier that holds it.  From the longest tier down, each waiting piece opens a sequence of its tier's size,
    whose gap takes the longest waiting pieces that fit, from the longest tier that may; the last of the gap takes the
    head of the shortest waiting piece, whose tail is routed anew.  At the end the rest, shorter than a window, is cut
    into sequences of powers of two, which need no padding.
    """

    def __init__(self, tiers: tuple[int, ...], first_id: int) -> None:
        if any(t & (t - 1) or t < 1 for t in tiers):
            raise ValueError("tiers are powers of two")
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.window = self.tiers[0]
        self.pool: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # (length, key), ascending
        self.held: dict[int, tuple[int, int]] = {}  # key: document, start
        self.docs: dict[int, list] = {}  # document: [id, ids, pieces that wait]
        self.waiting = 0
        self.next_key = self.next_seq = 0
        self.first_id = first_id
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []  # sequence's size, its pieces (document, start, length)
        self.n_docs = 0
        self.groups = 0

    def route(self, doc: int, start: int, length: int) -> None:
        tier = next(t for t in reversed(self.tiers) if length <= t)
        self.held[self.next_key] = (doc, start)
        insort(self.pool[tier], (length, self.next_key))
        self.next_key += 1
        self.waiting += length
        self.docs[doc][2] += 1

    def take(self, tier: int, at: int) -> tuple[int, int, int]:
        length, key = self.pool[tier].pop(at)
        doc, start = self.held.pop(key)
        self.waiting -= length
        self.docs[doc][2] -= 1
        return doc, start, length

    def add(self, doc_id, ids: np.ndarray) -> None:
        doc, self.n_docs = self.n_docs, self.n_docs + 1
        self.docs[doc] = [doc_id, ids, 0]
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.done.append((self.window, [(doc, start, self.window)]))
        if len(ids) > whole:
            self.route(doc, whole, len(ids) - whole)

    def fill(self, size: int, pieces: list[tuple[int, int, int]]) -> None:
        gap = size - sum(p[2] for p in pieces)
        while gap:
            for tier in self.tiers:
                at = bisect_right(self.pool[tier], (gap, sys.maxsize)) - 1
                if at >= 0:
                    pieces.append(self.take(tier, at))
                    break
            else:
                tier = next(t for t in reversed(self.tiers) if self.pool[t])
                doc, start, length = self.take(tier, 0)
                pieces.append((doc, start, gap))
                self.route(doc, start + gap, length - gap)
            gap = size - sum(p[2] for p in pieces)
        self.done.append((size, pieces))

    def pack(self, leave: int) -> None:
        """Opens sequences until no more than leave tokens wait, or too few for a window."""
        for tier in self.tiers:
            while self.pool[tier] and self.waiting >= max(leave, tier):
                self.fill(tier, [self.take(tier, len(self.pool[tier]) - 1)])

    def finish(self) -> None:
        self.pack(0)
        size = self.window
        while self.waiting:
            while size > self.waiting:
                size //= 2
            self.fill(size, [])

    def drain(self, final: bool) -> Iterator[tuple]:
        """Rows of the sequences made so far, dealt to step groups of equal tokens and near-equal attention cost.

        A unit is a full window or shorter sequences that make one up.  Units, by falling sum of squared piece
        lengths, are dealt to and fro over the groups.
        """
        self.done.sort(key=lambda s: -s[0])
        units, room = [], 0
        for seq in self.done:
            if room < seq[0]:
                units.append([])
                room = self.window
            units[-1].append(seq)
            room -= seq[0]
        rest = [] if final or not units else units[len(units) // STEP_WINDOWS * STEP_WINDOWS :]
        units = units[: len(units) - len(rest)]
        units.sort(key=lambda u: -sum(p[2] ** 2 for _, pieces in u for p in pieces))
        n_groups = -(-len(units) // STEP_WINDOWS)
        for i, unit in enumerate(units):
            lap, place = divmod(i, n_groups)
            group = self.first_id + self.groups + (place if lap % 2 == 0 else n_groups - 1 - place)
            for size, pieces in unit:
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids, _ = self.docs[doc]
                    yield doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), self.first_id + self.next_seq, offset, size, group
                    offset += length
                self.next_seq += 1
        self.groups += n_groups
        self.done = [seq for unit in rest for seq in unit]
        needed = {p[0] for _, pieces in self.done for p in pieces}
        for doc in [d for d, x in self.docs.items() if not x[2] and d not in needed]:
            del self.docs[doc]


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (id_col, start, length, ids, doc_tokens, sequence_id, offset, sequence_length, step_group).

    ids is the piece's tokens as little-endian unsigned 32-bit binary.  Each token of each row's whole text, and its
    end id, lies in exactly one piece.  sequence_id and step_group are unique over the table: the partition's number
    shifted left by 33 bits, and a count.  Sequences are as long as a tier or, the last ones of a partition, a smaller
    power of two, so none needs padding.  Null and empty texts are the end id alone; null and repeated ids are packed
    like others; a very long text is cut into windows.  Other columns are not read.  An empty table gives an empty result.

    Partitions are packed by themselves, without a shuffle, in one pass with bounded memory (a text, its tokens and a
    pool of POOL_TOKENS); a lost task gives the same rows again.
    """
    Packer(tiers, 0)
    kind = docs.schema[id_col].dataType

    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, TaskContext.get().partitionId() << 33)
        types = None
        added = 0

        def rows(final: bool) -> pa.RecordBatch:
            found = list(zip(*packer.drain(final), strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names)

        for b in batches:
            types = types or [b.column(0).type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokenize(text.as_py(), tokenizer)
                packer.add(doc_id, ids)
                added += len(ids)
                if added >= POOL_TOKENS:
                    packer.pack(POOL_TOKENS // 4)
                    yield rows(False)
                    added = 0
        if types:
            packer.finish()
            yield rows(True)

    schema = f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length int, step_group long"
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
