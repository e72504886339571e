"""Substring dedup: shared k-mer seeds, collinear chains through a Fenwick tree, aligned passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import discard, free_name, materialize
from quarrymill.llm.words import mixed, run_hashes, word_hashes

#: Words of a seed; one of EVERY is taken by its hash alone, so an edit elsewhere does not change the choice, and the least of
#: every WINDOW neighbours too, so every run of K + WINDOW - 1 words has one.
K, EVERY, WINDOW = 4, 4, 24
MIN_WORDS, MIN_IDENTITY = 50, 0.8
#: Cost of each word that a chain skips on either side.
GAP_COST = 0.1
#: Words looked at beyond a chain's ends.
FLANK = 60
#: A longer stretch without a seed ends a chain.
MAX_GAP = 60
#: Two seeds of a wide pair are this many words apart; each seed opens that many pairs.
PAIR_SPAN, PAIRS = (24, 60), 3
#: A chain counts if this many repeated seeds, of any source, are within reach of it.
LEAST_SEEDS = 3
#: Rows of one key that a task joins; a key with more is split.
HOT = 20_000
#: A source's slices start and end at multiples of this, so that many copies ask for the same one.
GRID = 64
WORD_AND_BLANKS = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width], for every full window."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def seeds_of(texts: list[bytes], k: int = K, every: int = EVERY, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, word position, hash, whether by the hash alone) of the seeds of lower-cased texts."""
    per = [run_hashes(word_hashes(t), k) for t in texts]
    n = np.array([len(p) for p in per])
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    room = n + window  # gaps keep windows within a text, where they may be cut short
    offset = window + np.concatenate(([0], np.cumsum(room)[:-1]))
    laid = np.full(int(room.sum()) + 2 * window, NONE)
    for p, at, m in zip(per, offset.tolist(), n.tolist(), strict=True):
        laid[at : at + m] = np.minimum(p, NONE - np.uint64(1))
    least = _sliding(laid, window, np.minimum)
    chosen = np.zeros(len(laid), bool)
    chosen[window - 1 : len(least)] = _sliding(least, window, np.maximum) == laid[window - 1 : len(least)]
    sampled = laid % np.uint64(every) == 0
    chosen |= sampled
    chosen[1:-1] &= (laid[1:-1] != laid[:-2]) | (laid[1:-1] != laid[2:])  # of a run of equal ones, both ends
    chosen &= laid != NONE
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(offset, at, side="right") - 1
    return doc, at - offset[doc], laid[at], sampled[at]


def shared_runs(words: np.ndarray, shared: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the runs of width words whose inner seeds, of those taken by the hash alone, are all at shared positions.

    Two equal runs have the same seeds of that kind, so a run that another text holds is among these.
    """
    h = run_hashes(words, width)
    if not len(h):
        return np.zeros(0, np.int64), h
    kmers = np.minimum(run_hashes(words, K), NONE - np.uint64(1))
    own = kmers % np.uint64(EVERY) == 0
    own[1:-1] &= (kmers[1:-1] != kmers[:-2]) | (kmers[1:-1] != kmers[2:])
    own[shared] = False
    alone = np.concatenate(([0], np.cumsum(own)))
    at = np.arange(len(h))
    keep = np.flatnonzero(alone[at + width - K + 1] == alone[at])
    return keep, h[keep]


def run_pieces(at: np.ndarray, source: np.ndarray, source_at: np.ndarray, width: int, own: int | None = None) -> list[tuple[int, int, int, int]]:
    """(start, source, source start, words) of equal stretches that together hold every run of width words given.

    own: the text's own number; a stretch that repeats the same text ends where its source would reach it.

    Runs of one source and shift that follow each other are one stretch; a stretch is left out if the ones before and
    after it hold all its words, as in a text of one repeated word, whose runs all have the same first place.
    """
    order = np.argsort(at, kind="stable")
    at, source, source_at = at[order], source[order], source_at[order]
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(source_at) != 1) | (source[1:] != source[:-1])) + 1
    edges = [0, *cuts.tolist(), len(at)]
    stretches = [(int(at[i]), int(source[i]), int(source_at[i]), int(at[j - 1] - at[i]) + width) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i]
    stretches = [(a, of, b, min(n, a - b) if of == own else n) for a, of, b, n in stretches]
    out: list[tuple[int, int, int, int]] = []
    reach = 0
    for i, (start, src, src_start, words) in enumerate(stretches):
        if i + 1 == len(stretches) or stretches[i + 1][0] > reach:
            out.append((start, src, src_start, words))
            reach = start + words
    return out


def wide_pairs(pos: np.ndarray, h: np.ndarray, src: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, second position) of pairs of a text's shared seeds, some words apart, whose first holders differ.

    Where a passage's seeds first occur in several texts that hold pieces of it, no single seed leads to a text
    that holds it whole; a pair of seeds from two pieces does.
    """
    order = np.argsort(pos, kind="stable")
    pos, h, src = pos[order].astype(np.int64), h[order], src[order]
    first = np.searchsorted(pos, pos + PAIR_SPAN[0])
    keys, one, two = [], [], []
    for step in range(PAIRS):
        j = first + step
        ok = j < len(pos)
        i, j = np.flatnonzero(ok), j[ok]
        ok = (pos[j] - pos[i] <= PAIR_SPAN[1]) & (src[i] != src[j]) & (src[i] != doc) & (src[j] != doc)
        i, j = i[ok], j[ok]
        keys.append(mixed(h[i] * np.uint64(3) + mixed(h[j])))
        one.append(pos[i])
        two.append(pos[j])
    return np.concatenate(keys), np.concatenate(one), np.concatenate(two)


class MaxTree:
    """Fenwick tree of prefix maxima: the best (value, item) among ranks up to a given one."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        at = rank + 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def up_to(self, rank: int) -> tuple[float, int]:
        """Over ranks below rank."""
        found = (float("-inf"), -1)
        while rank:
            if self.best[rank] > found:
                found = self.best[rank]
            rank -= rank & -rank
        return found


def chains_of(matches: list[tuple[int, int]], k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of matches (position in the text, in the source), best first.

    A chain rises strictly in both; it earns k for each match and pays gap_cost for each word passed on either side.
    As that cost is the difference of a sum at both ends, the best predecessor is a prefix maximum.
    """
    points = sorted(set(matches))
    levels = sorted({b for _, b in points})
    rank = {b: i for i, b in enumerate(levels)}
    tree = MaxTree(len(levels))
    score, prev = [0.0] * len(points), [-1] * len(points)
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j][0] == points[i][0]:
            a, b = points[j]
            before, item = tree.up_to(rank[b])
            gain = before - gap_cost * (a + b)
            score[j] = k + max(0.0, gain)
            prev[j] = item if gain > 0 else -1
            j += 1
        for m in range(i, j):
            a, b = points[m]
            tree.put(rank[b], (score[m] + gap_cost * (a + b), m))
        i = j
    used = [False] * len(points)
    found = []
    for end in sorted(range(len(points)), key=lambda m: (-score[m], m)):
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            if chain and max(chain[-1][0] - points[at][0], chain[-1][1] - points[at][1]) > max_gap + k:
                found.append(chain[::-1])
                chain = []
            chain.append(points[at])
            at = prev[at]
        if chain:
            found.append(chain[::-1])
    return [c for c in found if len(c) > 1]


def edit_columns(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[bool, int, int]]]:
    """Global alignments by least edits of pairs of word lists: columns (equal, words of the first, words of the second).

    Pairs of about one size share the rows of one table; within a row, insertions are a running minimum.
    """
    out: list[list[tuple[bool, int, int]]] = [[] for _ in pairs]
    sized: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(pairs):
        if not len(x) or not len(y):
            out[i] = [(False, 1, 0)] * len(x) + [(False, 0, 1)] * len(y)
        elif len(x) == len(y) and (x == y).all():
            out[i] = [(True, len(x), len(x))]
        else:
            sized.setdefault((-(-len(x) // 16) * 16, -(-len(y) // 16) * 16), []).append(i)
    for (n, m), members in sized.items():
        step = max(1, 8_000_000 // ((n + 1) * (m + 1)))
        for begin in range(0, len(members), step):
            some = members[begin : begin + step]
            xs, ys = np.zeros((len(some), n), np.uint64), np.zeros((len(some), m), np.uint64)
            for row, i in enumerate(some):
                xs[row, : len(pairs[i][0])], ys[row, : len(pairs[i][1])] = pairs[i]
            steps = np.arange(m + 1, dtype=np.int32)
            cost = np.empty((len(some), n + 1, m + 1), np.int32)
            cost[:, 0] = steps
            for r in range(1, n + 1):
                above, row = cost[:, r - 1], cost[:, r]
                row[:, 0] = r
                np.minimum(above[:, :-1] + (xs[:, r - 1, None] != ys), above[:, 1:] + 1, out=row[:, 1:])
                row -= steps
                np.minimum.accumulate(row, axis=1, out=row)
                row += steps
            for row, i in enumerate(some):
                out[i] = _walk_back(cost[row, : len(pairs[i][0]) + 1, : len(pairs[i][1]) + 1].tolist(), pairs[i][0].tolist(), pairs[i][1].tolist())
    return out


def _walk_back(cost: list[list[int]], x: list[int], y: list[int]) -> list[tuple[bool, int, int]]:
    out, i, j = [], len(x), len(y)
    while i and j:
        here = cost[i][j]
        same = x[i - 1] == y[j - 1]
        if here == cost[i - 1][j - 1] + (not same):
            out.append((same, 1, 1))
            i, j = i - 1, j - 1
        elif here == cost[i - 1][j] + 1:
            out.append((False, 1, 0))
            i -= 1
        else:
            out.append((False, 0, 1))
            j -= 1
    out += [(False, 1, 0)] * i + [(False, 0, 1)] * j
    return out[::-1]


def align(tasks: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]], k: int = K) -> list[list[tuple[bool, int, int]]]:
    """For each (text, source, anchors: positions of equal runs of k words): columns of the alignment of both wholes through the anchors."""
    gaps: list[tuple[np.ndarray, np.ndarray]] = []
    plans: list[list] = []
    for x, y, anchors in tasks:
        plan: list = []  # numbers of gaps, and (True, n, n) for anchors
        at = bt = 0
        for a, b in [*anchors, (len(x), len(y))]:
            end = (a, b) == (len(x), len(y))
            skip = 0 if end else max(0, at - a, bt - b)  # of an anchor that overlaps the one before, only the rest counts
            if skip < k:
                if a + skip > at or b + skip > bt:
                    plan.append(len(gaps))
                    gaps.append((x[at : a + skip], y[bt : b + skip]))
                if not end:
                    plan.append((True, k - skip, k - skip))
                    at, bt = a + k, b + k
        plans.append(plan)
    done = edit_columns(gaps)
    return [[c for p in plan for c in (done[p] if isinstance(p, int) else [p])] for plan in plans]


def hopeful(x: np.ndarray, y: np.ndarray, min_words: int, min_identity: float) -> bool:
    """Whether enough words of some stretch of x occur in y at all.  Never false where a passage is: of a stretch of identity i
    and at least min_words words, some window of min_words has at least (2 i - 1) + (1 - i) / 2 of its words in y."""
    if len(x) < min_words:
        return False
    have = np.concatenate(([0], np.cumsum(np.isin(x, y))))
    return int((have[min_words:] - have[:-min_words]).max()) >= min_words * (min_identity - (1 - min_identity) / 2)


def passages_of(columns: list[tuple[bool, int, int]], min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """Disjoint stretches of an alignment that keep the identity: (start, words, source start, source words, equal words).

    An equal word earns 1 - identity and any other column costs identity, so a stretch whose sum is not negative has the
    identity.  Of the stretches of at least min_words words that start and end with an equal word, the one of the
    highest sum is taken, then those to its left and right.
    """
    equal = np.array([c[0] for c in columns], bool)
    words = np.concatenate(([0], np.cumsum([c[1] for c in columns])))
    source = np.concatenate(([0], np.cumsum([c[2] for c in columns])))
    gain = np.concatenate(([0.0], np.cumsum([(1 - min_identity) * c[1] if c[0] else -min_identity * max(c[1], c[2]) for c in columns])))
    same = np.concatenate(([0], np.cumsum([c[1] if c[0] else 0 for c in columns])))
    found = []
    todo = [(0, len(columns))]
    while todo:
        lo, hi = todo.pop()
        if words[hi] - words[lo] < min_words:
            continue
        starts = np.where(equal[lo:hi], gain[lo:hi], np.inf)
        least = np.minimum.accumulate(starts)
        latest = np.searchsorted(words[lo:hi], words[lo + 1 : hi + 1] - min_words, side="right") - 1  # of the starts that leave enough words
        sums = np.where(equal[lo:hi] & (latest >= 0), gain[lo + 1 : hi + 1] - least[latest], -np.inf)
        end = int(np.argmax(sums))
        if sums[end] < -1e-9:
            continue
        a, b = lo + int(np.argmax(starts == least[latest[end]])), lo + end + 1
        found.append((int(words[a]), int(words[b] - words[a]), int(source[a]), int(source[b] - source[a]), int(same[b] - same[a])))
        todo += [(lo, a), (b, hi)]
    return sorted(found)


def part_of(columns: list[tuple[bool, int, int]], start: int, source_start: int, most: int) -> list[tuple[bool, int, int]]:
    """The columns from the words start and source_start on, up to most words of the source."""
    out, i, j = [], 0, 0
    for equal, n, m in columns:
        skip = max(0, min(start - i, n), min(source_start - j, m)) if equal else 0
        if (i + n > start or n == 0 and i >= start) and (j + m > source_start or m == 0 and j >= source_start):
            if equal:
                n = m = min(n - skip, most)
            if m > most:
                break
            if n or m:
                out.append((equal, n, m))
            most -= m
            if not most:
                break
            i, j = i + n + skip, j + m + skip
        else:
            i, j = i + n, j + m
    return out


class Numbered:
    """The texts of docs under numbers: a row's id where it is not null and has one text, else a hash of id and text.

    rows: (doc, text), each text of an id once.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        digest = own.select("id", F.xxhash64("text").alias("h"))
        several = digest.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n")).where("n > 1 OR id IS NULL")
        self.several = materialize(several.select(F.col("id").alias("several_id"), (F.col("id").isNull() | (F.col("a") != F.col("b"))).alias("differ")), "sub-ids")
        self.plain = self.several.isEmpty()
        if self.plain:
            self.rows = own.select(F.col("id").alias("doc"), "text")
        else:
            once = own.join(self.several, own["id"] == F.col("several_id"), "left_anti").where("id IS NOT NULL").select(F.col("id").alias("doc"), "text")
            more = own.join(self.several, own["id"].eqNullSafe(F.col("several_id")))
            more = more.select(F.when(F.col("differ"), self.hashed(F.col("id"), F.col("text"))).otherwise(F.col("id")).alias("doc"), "text").distinct()
            self.rows = once.union(more)
            names = own.join(self.several.where("differ"), own["id"].eqNullSafe(F.col("several_id")))
            self.names = materialize(names.select(self.hashed(F.col("id"), F.col("text")).alias("no"), F.col("id").alias("named")).distinct(), "sub-names")

    @staticmethod
    def hashed(id_: Column, text: Column) -> Column:
        return F.xxhash64(F.lit("row"), F.coalesce(id_, F.lit(0)), id_.isNull(), text)

    def number(self, docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
        """docs with the number of each row."""
        if self.plain:
            return docs.withColumn(name, F.when(docs[text_col].isNotNull(), docs[id_col].cast("long")))
        joined = docs.join(self.several.where("differ"), docs[id_col].cast("long").eqNullSafe(F.col("several_id")), "left")
        number = F.when(F.col("differ"), self.hashed(docs[id_col].cast("long"), docs[text_col])).otherwise(docs[id_col].cast("long"))
        return joined.select(*[docs[c] for c in docs.columns], F.when(docs[text_col].isNotNull(), number).alias(name))

    def named(self, found: DataFrame, *cols: str) -> DataFrame:
        """found with ids in place of numbers."""
        if self.plain:
            return found
        for c in cols:
            own = self.names.select(F.col("no").alias("no_"), F.col("named").alias("named_"), F.lit(True).alias("known_"))
            found = found.join(own, F.col(c) == F.col("no_"), "left").withColumn(c, F.when(F.col("known_"), F.col("named_")).otherwise(F.col(c))).drop("no_", "named_", "known_")
        return found


def first_places(table: DataFrame, label: str, second: bool = False) -> DataFrame:
    """Rows (h, doc, pos[, pos2]) of keys that occur again, with the key's first place: src (least doc) and src_pos[, src_pos2].

    Keys are counted before their rows are joined, and the first places come from the rows of shared keys alone.  Both
    joins hash the side of unique keys, so the rows themselves are not sorted; those of a key with more than HOT are dealt
    over several tasks.
    """
    counted = table.groupBy("h").agg(F.min("doc").alias("src"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(counted.select(F.col("h").alias("key"), "src", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), f"{label}-shared")
    hits = materialize(table.join(shared.hint("shuffle_hash"), F.col("h") == F.col("key")).drop("key"), f"{label}-hits")
    place = F.shiftleft(F.col("pos").cast("long"), 32)
    place = place + F.col("pos2") if second else place
    first = hits.where("doc = src").groupBy(F.col("h").alias("key")).agg(F.min(place).alias("at"), F.min("parts").alias("of"))
    first = first.select("key", "at", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("mine"))
    names = [F.shiftright("at", 32).cast("int").alias("src_pos"), *([F.col("at").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("src_pos2")] if second else [])]
    dealt = hits.withColumn("part", F.pmod(F.xxhash64("doc", "pos"), F.col("parts")).cast("int"))
    both = dealt.join(first.hint("shuffle_hash"), (F.col("h") == F.col("key")) & (F.col("part") == F.col("mine")))
    out = materialize(both.select(*[c for c in hits.columns if c != "parts"], *names), f"{label}-links")
    discard(shared, hits)
    return out


def _lists(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a list of structs, flat, and where each row's entries end."""
    flat = column.flatten()
    return [np.asarray(flat.field(j)) for j in range(flat.type.num_fields)], np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths()))))


CHAIN_NAMES = ["doc", "src", "lo", "n", "slo", "sn", "anchors"]
CHAIN_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32())]
CHAIN_SCHEMA = "doc long, src long, lo int, n int, slo int, sn int, anchors array<int>"
#: A text's chains stay in its row until it is known which of them need aligning.
CHAINS_SCHEMA = "doc long, chains array<struct<src: long, lo: int, n: int, slo: int, sn: int, anchors: array<int>, first: boolean>>"


def _chain_row(doc: int, src: int, anchors: list[tuple[int, int]], end: tuple[int, int]) -> tuple:
    """Slices of text and source around anchors (which end before end), and the anchors within them."""
    lo, slo = max(0, anchors[0][0] - FLANK), max(0, anchors[0][1] - FLANK) // GRID * GRID
    stop = -(-(end[1] + FLANK) // GRID) * GRID
    return doc, src, lo, end[0] + FLANK - lo, slo, stop - slo, [v for a, b in anchors for v in (a - lo, b - slo)]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _lists_batch(ids: list[int], rows: list[tuple], ends: list[int]) -> pa.RecordBatch:
    """Rows (doc, chains): rows[ends[i] : ends[i + 1]] (of CHAIN_NAMES but doc, then first) are those of ids[i]."""
    names, types = [*CHAIN_NAMES[1:], "first"], [*CHAIN_TYPES[1:], pa.bool_()]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc", "chains"])


def _slices(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """(d, lo, n, said: 64-bit hashes of the words) of spans (d, lo, n); each text is split once for all its spans."""
    asked = spans.groupBy("d").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    texts = rows.join(asked, F.col("doc") == F.col("d")).select("d", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (lo, n), ends = _lists(b.column(2))
            ids, out, size = np.asarray(b.column(0)), [], 0
            for i in range(b.num_rows):
                words = word_hashes(b.column(1)[i].as_py().encode().lower())
                for j in range(ends[i], ends[i + 1]):
                    part = words[lo[j] : lo[j] + n[j]].tobytes()
                    out.append((ids[i], lo[j], n[j], part))
                    size += len(part)
                    if size > 8_000_000:
                        yield _batch(out, ["d", "lo", "n", "said"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])
                        out, size = [], 0
            yield _batch(out, ["d", "lo", "n", "said"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    return texts.mapInArrow(cut, "d long, lo int, n int, said binary")


def _aligned(chains: DataFrame, rows: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """The passages that the alignments through the chains' anchors keep."""
    spans = chains.select(F.col("doc").alias("d"), "lo", "n").union(chains.select("src", "slo", "sn"))
    spans = materialize(_slices(spans, rows), "sub-spans")  # of a doc's spans one row each, so joins below have unique keys
    own = spans.select(F.col("d").alias("d1"), F.col("lo").alias("lo1"), F.col("n").alias("n1"), F.col("said").alias("x"))
    other = spans.select(F.col("d").alias("d2"), F.col("lo").alias("lo2"), F.col("n").alias("n2"), F.col("said").alias("y"))
    # the source's side first: many chains may ask for one slice, and the second join deals them out by their own documents
    both = chains.join(other, (F.col("src") == F.col("d2")) & (F.col("slo") == F.col("lo2")) & (F.col("sn") == F.col("n2")))
    both = both.join(own, (F.col("doc") == F.col("d1")) & (F.col("lo") == F.col("lo1")) & (F.col("n") == F.col("n1")))
    both = both.select("doc", "src", "lo", "slo", "anchors", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "words", "src", "source_start", "source_words", "equal"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            for begin in range(0, b.num_rows, 200):
                tasks, kept = [], []
                for r in b.slice(begin, 200).to_pylist():
                    x, y = np.frombuffer(r["x"], np.uint64), np.frombuffer(r["y"], np.uint64)
                    anchors = list(zip(r["anchors"][::2], r["anchors"][1::2], strict=True))
                    # the source's slice is wider than needed: no more of it than FLANK beyond the anchors
                    cut = max(0, anchors[0][1] - FLANK)
                    y = y[cut : anchors[-1][1] + K + FLANK]
                    if hopeful(x, y, min_words, min_identity):
                        tasks.append((x, y, [(p, q - cut) for p, q in anchors]))
                        kept.append((r["doc"], r["lo"], r["src"], r["slo"] + cut))
                out = []
                for (doc, lo, src, slo), columns in zip(kept, align(tasks), strict=True):
                    for a, n, s, m, same in passages_of(columns, min_words, min_identity):
                        if doc != src or slo + s + m <= lo + a:
                            out.append((doc, lo + a, n, src, slo + s, m, same))
                            continue
                        part = part_of(columns, a, s, lo + a - slo - s)  # a copy within the text ends where its source would reach it
                        out += [(doc, lo + a + p, n, src, slo + s + q, m, same) for p, n, q, m, same in passages_of(part, min_words, min_identity)]
                yield _batch(out, names, types)

    found = materialize(both.mapInArrow(check, "doc long, start int, words int, src long, source_start int, source_words int, equal int"), "sub-found")
    discard(spans)
    return found


def _uncovered(at: np.ndarray, width: int, spans: list[dict]) -> np.ndarray:
    """Which runs of width words, at rising places, are not wholly inside the union of spans."""
    bare = np.ones(int(at.max(initial=0)) + width + 1, np.int64)
    bare[0] = 0
    for s in spans:
        bare[s["start"] + 1 : s["start"] + s["words"] + 1] = 0
    bare = np.cumsum(bare)
    return bare[at + width] > bare[at]


def _least_kmers(words: np.ndarray, width: int) -> np.ndarray:
    """The least k-mer of every run of width words.  It is a seed of any text that holds the run, as WINDOW is less than its k-mers."""
    return _sliding(np.minimum(run_hashes(words, K), NONE - np.uint64(1)), width - K + 1, np.minimum)


def _unfound_runs(links: DataFrame, rows: DataFrame, held: DataFrame, min_words: int) -> DataFrame:
    """Chains (see CHAIN_SCHEMA) over the exact runs of min_words words that held (d, held: found passages) does not hold whole.

    Of those runs the least k-mers are gathered; then every run with one of these, in any text, is matched with its first place.
    """
    # a run that an earlier place holds has no seed that is at its own first place
    shared = links.where("doc <> src OR pos > src_pos").groupBy(F.col("doc").alias("d0")).agg(F.collect_set("pos").alias("shared"))
    texts = rows.join(shared, F.col("doc") == F.col("d0")).join(held, F.col("doc") == F.col("d"), "left").select("doc", "text", "shared", "held")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = np.asarray(b.column(2).flatten()), np.concatenate(([0], np.cumsum(np.asarray(b.column(2).value_lengths()))))
            found = [np.zeros(0, np.uint64)]
            for i in range(b.num_rows):
                words = word_hashes(b.column(1)[i].as_py().encode().lower())
                at, _ = shared_runs(words, flat[ends[i] : ends[i + 1]], min_words)
                if len(at):
                    at = at[_uncovered(at, min_words, b.column(3)[i].as_py() or [])]
                    found.append(_least_kmers(words, min_words)[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["asked"])

    asked = materialize(texts.select("doc", "text", "shared", "held").mapInArrow(ask, "asked long").distinct(), "sub-asked")
    holders = links.join(asked, F.col("h") == F.col("asked"), "left_semi").groupBy(F.col("doc").alias("d")).agg(F.collect_set("h").alias("asked"))
    texts = rows.join(holders, F.col("doc") == F.col("d")).select("doc", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            flat, ends = np.asarray(b.column(2).flatten()), np.concatenate(([0], np.cumsum(np.asarray(b.column(2).value_lengths()))))
            kept: list[tuple] = []
            size = 0
            for i in range(b.num_rows):
                words = word_hashes(b.column(1)[i].as_py().encode().lower())
                h = run_hashes(words, min_words)
                at = np.flatnonzero(np.isin(_least_kmers(words, min_words).view(np.int64), flat[ends[i] : ends[i + 1]])) if len(h) else np.zeros(0, np.int64)
                kept.append((np.full(len(at), ids[i]), at.astype(np.int32), h[at].view(np.int64)))
                size += len(at)
                if size > 200_000 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], ["doc", "pos", "h"])
                    kept, size = [], 0

    runs = materialize(texts.mapInArrow(run, "doc long, pos int, h long"), "sub-runs")
    places = first_places(runs, "sub-run")
    discard(runs, asked)
    again = places.where((F.col("doc") != F.col("src")) | (F.col("pos") >= F.col("src_pos") + min_words))
    repeats = again.groupBy("doc").agg(F.collect_list(F.struct("pos", "src", "src_pos")).alias("links"))
    both = repeats.join(held, F.col("doc") == F.col("d"), "left").select("doc", "links", "held")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            ids, ((pos, src, src_pos), ends) = np.asarray(b.column(0)), _lists(b.column(1))
            for i in range(b.num_rows):
                own = slice(ends[i], ends[i + 1])
                at = pos[own].astype(np.int64)
                open_ = _uncovered(at, min_words, b.column(2)[i].as_py() or [])
                for a, of, s, words in run_pieces(at[open_], src[own][open_], src_pos[own][open_].astype(np.int64), min_words, ids[i]):
                    steps = [*range(0, words - K, K), words - K]
                    out.append(_chain_row(ids[i], of, [(a + j, s + j) for j in steps], (a + words, s + words)))
            yield _batch(out, CHAIN_NAMES, CHAIN_TYPES)

    chains = materialize(both.mapInArrow(leave, CHAIN_SCHEMA), "sub-rest")
    discard(places)
    return chains


def needed_first(chains: list[tuple[int, list[tuple[int, int]]]]) -> list[bool]:
    """Of a text's chains (source, anchors), which hold a word that no better one's alignment reaches: more anchors, then the
    smaller source.  The others are aligned later, where no passage was found about them."""
    order = sorted(range(len(chains)), key=lambda i: (-len(chains[i][1]), chains[i][0], chains[i][1][0]))
    reached = np.zeros(max((c[-1][0] for _, c in chains), default=0) + K, bool)
    out = [False] * len(chains)
    for i in order:
        first, last = chains[i][1][0][0], chains[i][1][-1][0] + K
        out[i] = not reached[first:last].all()
        if out[i]:
            reached[max(0, first - FLANK) : last + FLANK] = True
    return out


def _copies(rows: DataFrame) -> DataFrame:
    """(copy, of): texts that equal one of a smaller number, and the smallest such."""
    digests = materialize(rows.select("doc", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")), "sub-digests")
    first = digests.groupBy(F.col("digest").alias("d")).agg(F.min("doc").alias("of"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(digests.join(first, F.col("digest") == F.col("d")).where("doc <> of").select(F.col("doc").alias("copy"), "of"), "sub-copies")
    discard(digests)
    return copies


def _whole_texts(rows: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    """The copies as passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t.encode().split()) for t in b.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc", "src", "words"])

    texts = rows.join(copies, F.col("doc") == F.col("copy")).select("doc", "of", "text")
    zero = F.lit(0)
    return texts.mapInArrow(count, "doc long, src long, words int").where(F.col("words") >= min_words).select("doc", zero.alias("start"), "words", "src", zero.alias("source_start"), F.col("words").alias("source_words"), F.col("words").alias("equal"))


def _passages(rows: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """The passages of find_passages() over rows (doc, text), documents by number."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            texts = b.column(1).to_pylist()
            done = 0
            while done < len(texts):
                end, size = done, 0
                while end < len(texts) and (end == done or size < 4_000_000):
                    size += len(texts[end])
                    end += 1
                d, p, h, _ = seeds_of([t.encode().lower() for t in texts[done:end]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[done:end][d]), pa.array(p.astype(np.int32)), pa.array(h.view(np.int64))], ["doc", "pos", "h"])
                done = end

    copies = _copies(rows)
    seeds = rows.mapInArrow(seed, "doc long, pos int, h long").join(copies, F.col("doc") == F.col("copy"), "left_anti")
    seeds = materialize(seeds, "sub-seeds")
    links = first_places(seeds, "sub-seed")
    discard(seeds)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ((pos, h, src), ends) = np.asarray(b.column(0)), _lists(b.column(1))
            for i in range(b.num_rows):
                own = slice(ends[i], ends[i + 1])
                key, one, two = wide_pairs(pos[own], h[own].view(np.uint64), src[own], ids[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), ids[i])), pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(key.view(np.int64))], ["doc", "pos", "pos2", "h"])

    listed = links.where("doc <> src").groupBy("doc").agg(F.min("src").alias("a"), F.max("src").alias("b"), F.collect_list(F.struct("pos", "h", "src")).alias("m")).where("a <> b").select("doc", "m")
    pairs = materialize(listed.mapInArrow(widen, "doc long, pos int, pos2 int, h long"), "sub-pairs")
    wide = first_places(pairs, "sub-pair", second=True).where("doc <> src")
    discard(pairs)
    matches = links.where("doc <> src OR pos > src_pos").select("doc", "src", "pos", "src_pos")
    matches = matches.union(wide.select("doc", "src", "pos", "src_pos")).union(wide.select("doc", "src", "pos2", "src_pos2"))
    grouped = matches.groupBy("doc").agg(F.collect_list(F.struct("src", "pos", "src_pos")).alias("m"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            laid = [0]
            (of, a, s), ends = _lists(b.column(1))
            docs = b.column(0).to_pylist()
            for i in range(b.num_rows):
                own = slice(ends[i], ends[i + 1])
                order = np.argsort(of[own], kind="stable")
                o, x, y = of[own][order], a[own][order], s[own][order]
                cuts = np.flatnonzero(np.diff(o)) + 1
                found: list[tuple[int, list[tuple[int, int]]]] = []
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(o)], strict=True):
                    if hi - lo > 1:
                        found += [(int(o[lo]), c) for c in chains_of(list(zip(x[lo:hi].tolist(), y[lo:hi].tolist(), strict=True)))]
                places = np.unique(a[own])
                near = [np.searchsorted(places, c[-1][0] + FLANK, "right") - np.searchsorted(places, c[0][0] - FLANK) for _, c in found]
                found = [c for c, n in zip(found, near, strict=True) if n >= LEAST_SEEDS]
                for (src, c), first in zip(found, needed_first(found), strict=True):
                    out.append((*_chain_row(docs[i], src, c, (c[-1][0] + K, c[-1][1] + K))[1:], first))
                laid.append(len(out))
            yield _lists_batch(docs, out, laid)

    def inside(c: Column) -> Column:
        begin, end = c["lo"] + c["anchors"][0], c["lo"] + F.element_at(c["anchors"], -2) + K
        return F.coalesce(F.exists("held", lambda h: (h["start"] <= begin) & (h["start"] + h["words"] >= end)), F.lit(False))

    chains = materialize(grouped.mapInArrow(chain, CHAINS_SCHEMA), "sub-chains")
    discard(wide)
    firsts = chains.select("doc", F.inline(F.filter("chains", lambda c: c["first"]))).select(*CHAIN_NAMES)
    found = _aligned(firsts, rows, min_words, min_identity)
    held = materialize(found.groupBy(F.col("doc").alias("d")).agg(F.collect_set(F.struct("start", "words")).alias("held")), "sub-held")
    others = chains.select("doc", F.filter("chains", lambda c: ~c["first"]).alias("chains")).where(F.size("chains") > 0)
    others = others.join(held, F.col("doc") == F.col("d"), "left")
    later = others.select("doc", F.inline(F.filter("chains", lambda c: ~inside(c)))).select(*CHAIN_NAMES)
    rest = _unfound_runs(links, rows, held, min_words)
    more = _aligned(later.union(rest), rows, min_words, min_identity)
    whole = _whole_texts(rows, copies, min_words)
    discard(links, chains, rest)
    return materialize(found.union(more).distinct().union(whole), "sub-passages")


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages of documents that repeat, exactly or nearly, a passage of an earlier document or an earlier one of the same.

    One row for each: (id_col, start, words, source_id, source_start, source_words, equal): positions count words
    (split at ASCII white space, A-Z lower-cased) from zero.  Passages have at least min_words words in the document and
    at least min_identity of the alignment's columns equal.  Passages may overlap.  Earlier: of smaller id.

    A text that equals another wholly is one passage of it.  Each seed of the rest is matched with its first place alone, so a passage that a third of the documents share gives a match for
    each of them, not for each pair.  Two further keys make up for that: pairs of seeds some words apart whose first holders
    differ, each matched with the pair's own first place; and every run of min_words words of which all seeds
    are shared, with its own.  So every word of a run of min_words words that an earlier document holds exactly is in a
    passage, whatever pieces of it others hold.  Nearly equal passages need two seeds in common, or a pair, with their first
    holder, and LEAST_SEEDS repeated seeds about them; the tests measure how many are found.

    Null texts take no part.  Rows that share an id but not the text, and rows without an id, take part each under a
    number of its own, a hash, so which of them is the earlier is arbitrary but fixed; a row that repeats another wholly
    counts once.  Texts without a word have no passage.  Other columns are not read.  An empty table gives an empty result.
    """
    numbered = Numbered(docs, id_col, text_col)
    found = numbered.named(_passages(numbered.rows, min_words, min_identity), "doc", "src")
    return found.select(F.col("doc").alias(id_col), "start", "words", F.col("src").alias("source_id"), "source_start", "source_words", "equal")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, words), each with the white space after it."""
    at, kept, last = 0, [], 0
    drop = sorted(spans)
    reach = -1
    for i, m in enumerate(WORD_AND_BLANKS.finditer(text)):
        while at < len(drop) and drop[at][0] <= i:
            reach = max(reach, sum(drop[at]))
            at += 1
        if i < reach:
            kept.append(text[last : m.start()])
            last = m.end()
    kept.append(text[last:])
    return "".join(kept)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """docs with every passage that find_passages() reports cut from the document that repeats it.

    chars_col, where docs has it, becomes the code points of the text.  Rows of which no word is left go; rows that
    had no word before stay, as do null texts.
    """
    numbered = Numbered(docs, id_col, text_col)
    found = _passages(numbered.rows, min_words, min_identity).select(F.col("doc").alias("of"), F.struct("start", "words").alias("span"))
    spans = materialize(found.groupBy("of").agg(F.collect_set("span").alias("spans")), "sub-cuts")
    of, own = spans["of"], spans["spans"]
    number = free_name(docs, "row_number")
    joined = numbered.number(docs, id_col, text_col, number)
    joined = joined.join(spans, joined[number] == of, "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_spans(t, [(s["start"], s["words"]) for s in c]) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    name = free_name(joined, "cut_text")
    # a UDF runs on every row, so rows without a span hand it a null
    out = joined.withColumn(name, F.when(of.isNotNull(), cut(F.when(of.isNotNull(), docs[text_col]), own)).otherwise(docs[text_col]))
    out = out.where(of.isNull() | F.col(name).rlike(r"[^\x20\x09-\x0D]"))
    changed = {text_col: F.col(name)}
    if chars_col and chars_col in docs.columns:
        changed[chars_col] = F.when(of.isNull(), docs[chars_col]).otherwise(F.length(name)).cast(docs.schema[chars_col].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])
