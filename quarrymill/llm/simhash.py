"""Near-duplicate documents by SimHash with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import connected_components, discard, materialize, spread
from quarrymill.llm.words import mixed, run_hashes, word_hashes

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of the whole text; A-Z lower-cased, words split at ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of sizes[i] hashes, the bits set in over half of them (an empty run: zero).

    Eight bits at a time are counted in the byte lanes of one 64-bit sum, over blocks of at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    own = sizes[full]
    first = np.concatenate(([0], np.cumsum(own)[:-1]))
    blocks = (own + 254) // 255
    block_of = np.repeat(np.arange(len(own)), blocks)
    within = np.arange(len(block_of)) - np.repeat(np.concatenate(([0], np.cumsum(blocks)[:-1])), blocks)
    block_start = first[block_of] + 255 * within
    run_start = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, block_start)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_start, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > own).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def simhashes(texts: list[str | None], width: int = 3) -> np.ndarray:
    """Fingerprints in slices of some millions of shingles, so that memory stays bounded by the longest text."""
    out, held, sizes, held_n = [], [], [], 0
    for text in texts:
        own = np.array(shingle_hashes(text, width), np.uint64)
        held.append(own)
        sizes.append(len(own))
        held_n += len(own)
        if held_n > 1_000_000:
            out.append(majority_bits(np.concatenate(held), np.array(sizes)))
            held, sizes, held_n = [], [], 0
    if sizes:
        out.append(majority_bits(np.concatenate(held), np.array(sizes)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): one row for each row of docs, fp as a signed long."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = simhashes(b.column(1).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


SEGMENT = 32


def variants(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(key, node): one-wildcard signatures of the nodes' fingerprints, each a long of columns cut into two segments.

    key: which segment, where its wildcard is, and the segment without that bit.  Of two segments, one differs by
    at most one bit if 64 bits differ by at most three; then the two fingerprints share a signature.
    """
    parts = ", ".join(f"{c} & 4294967295L, shiftrightunsigned({c}, 32)" for c in columns)
    n = 2 * len(columns) * SEGMENT
    cut = spread(nodes, "node").select("node", F.expr(f"array({parts})").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("v"))
    key = f"shiftleft(cast(v AS bigint), 32) | (element_at(parts, cast(v div {SEGMENT} AS int) + 1) & ~shiftleft(1L, v % {SEGMENT}))"
    return cut.select(F.expr(key).alias("key"), "node")


def _labelled(df: DataFrame, labels: DataFrame | None, *names: str) -> DataFrame:
    """df with l_<name>: the component of the node in that column so far."""
    for name in names:
        if labels is None:
            df = df.withColumn(f"l_{name}", F.col(name))
        else:
            own = labels.select(F.col("node").alias(f"n_{name}"), F.col("component").alias(f"c_{name}"))
            df = df.join(own, F.col(name) == F.col(f"n_{name}"), "left").withColumn(f"l_{name}", F.coalesce(f"c_{name}", name)).drop(f"n_{name}", f"c_{name}")
    return df


def _several(members: DataFrame, labels: DataFrame | None, used: list[DataFrame]) -> DataFrame:
    """members, with their labels, under keys that hold several components; tables it reads are added to used."""
    own = materialize(_labelled(members, labels, "node").select(*members.columns, F.col("l_node").alias("label")), "near-own")
    several = own.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("k")
    apart = materialize(own.join(several, F.col("key") == F.col("k"), "left_semi"), "near-mixed")
    used += [own, apart]
    return apart


def linked(keyed: DataFrame, verify: Callable[[DataFrame], DataFrame], closer: Callable[[DataFrame], DataFrame] | None = None, could: Callable[[str, str], Column] | None = None) -> tuple[DataFrame | None, list[DataFrame]]:
    """(node, component) of all nodes that a link joins, without emitting the pairs of large groups; and tables it reads.

    keyed: (key, node), nodes being longs; a link is a pair with a common key that verify keeps.  verify takes pairs
    (a, b) and may be asked for one again.  Three rounds, each leaving out pairs that the links found so far join:
    each node with the least of its buckets' smallest nodes; each bucket's nodes with its smallest; all pairs of
    buckets that still hold several components.  A large group of near copies is one component after the
    first two, which are linear; what is left pairs by pairs are nodes that none of them links.  No pair is lost: one
    that shares a key is either joined already or compared.

    closer: given the nodes (node) of buckets that still hold several components, a table (key, node, size, at) in which
    any two that verify keeps have a common key, and could (of the names of two rows of it) holds for them there.  It
    takes the place of the third round's buckets: first each node with the one of least at under its keys, then all
    pairs under keys that still hold several components.
    """
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("n > 1 AND least <> most"), "near-buckets")
    crowds = buckets.where("n > 2").select(F.col("key").alias("k"), "least")
    members = materialize(keyed.join(crowds, F.col("key") == F.col("k")).select("key", "node", "least"), "near-members")
    twos = buckets.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    stars = materialize(twos.union(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct(), "near-stars")
    labels, used = None, [members]
    for round_ in range(3 if closer is None else 4):
        if round_ == 0:
            pairs = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        elif round_ == 1:
            pairs = _labelled(stars, labels, "a", "b").where("l_a <> l_b").select("a", "b")
        elif round_ == 2:
            apart = _several(members, labels, used)
            if closer is None:
                x, y = apart.alias("x"), apart.alias("y")
                pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")))
            else:
                index = materialize(closer(apart.select("node").distinct()), "near-index")
                used.append(index)
                x = _several(index, labels, used)
                y = x.groupBy("key").agg(F.min(F.struct("at", "node", "size", "label")).alias("y")).select("key", "y.*")
                x, y = x.alias("x"), y.alias("y")
                pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & could("x", "y"))
            pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        else:
            apart = _several(index, labels, used)
            x, y = apart.alias("x"), apart.alias("y")
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & could("x", "y"))
            pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        found = materialize(verify(pairs), "near-found")
        ends = _labelled(found, labels, "a", "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))
        roots = connected_components(ends, "a", "b")
        if labels is None:
            nxt = roots
        else:
            moved = roots.select(F.col("node").alias("was"), F.col("component").alias("root"))
            old = labels.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("root", "component").alias("component"))
            fresh = roots.join(labels.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
            nxt = old.union(fresh)
        labels = materialize(nxt.distinct(), "near-labels")
        used += [found, labels]
        if round_ == 0:
            used += [stars, buckets]
    return labels, used


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """One row for each row of docs: (id_col, fp long, fingerprint string, component_id).

    component_id is the smallest id reachable over links of at most max_bits differing bits.
    Null and empty texts and texts of white space have fingerprint zero and link like any other.  Repeated rows
    stay, each with its component.  A null id gets the component of its fingerprint (null if all of it is null).
    Other columns of docs, whatever their names, are not read.  An empty table gives an empty result.

    Rows with one fingerprint are one node; see linked() for what keeps large groups from emitting their pairs.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    fps = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = materialize(fps.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("rep")), "simhash-nodes")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    labels, used = linked(variants(nodes.withColumn("fp0", F.col("node")), ["fp0"]), lambda pairs: pairs.where(close))
    named = nodes.join(labels.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    least = named.groupBy(F.col("root").alias("root_")).agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, F.col("root") == F.col("root_")).select(F.col("node").alias("fp_"), "component_id"), "simhash-named")
    discard(nodes, *used)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, F.col("fp") == F.col("fp_")).select(F.col("id").alias(id_col), "fp", hexed, "component_id")


def word_sketches(texts: list[str | None]) -> np.ndarray:
    """Three fingerprints (a row each) of the set of words of every text; A-Z lower-cased."""
    out: list[np.ndarray] = []
    held: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(np.unique(word_hashes(text.encode().lower())) if text else np.zeros(0, np.uint64))
        size += len(held[-1])
        if size > 500_000 or i + 1 == len(texts):
            sizes, all_ = np.array([len(h) for h in held]), np.concatenate(held)
            out.append(np.stack([majority_bits(mixed(all_ * np.uint64(m) + np.uint64(m >> 7)), sizes) for m in MULTIPLIERS], axis=1))
            held, size = [], 0
    return np.concatenate(out) if out else np.zeros((0, len(MULTIPLIERS)), np.uint64)


MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Of the 192 bits of three fingerprints; far above what texts of similarity 0.8 differ by (about 20).
MOST_BITS = 48


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, digest, component_id): one row for each row of docs with a word.

    Texts link if the Jaccard similarity of their sets of word shingles (A-Z lower-cased; fewer words: the whole sequence)
    is at least similarity; component_id is the smallest id reachable, null if all ids of the component are null.

    Candidates come from three 64-bit fingerprints over the set of words, cut into six segments: texts meet if one of them
    agrees but for one bit.  A changed word alters one member of that set but five shingles, so near copies
    differ in fewer bits than fingerprints of shingles would; every candidate is then verified on its shingles.  Texts that
    meet but are not linked to one text of their segment are compared where they share one of their rarest shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = word_sketches(b.column(2).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(bits[:, i], pa.int64()) for i in range(3))], ["id", "digest", "fp0", "fp1", "fp2"])

    text = F.col(text_col)
    worded = docs.where(text.rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(worded.select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest binary, fp0 long, fp1 long, fp2 long"), "copies-rows")
    fps = ["fp0", "fp1", "fp2"]
    nodes = rows.groupBy("digest").agg(F.min("id").alias("rep"), *[F.min(c).alias(c) for c in fps])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "copies-nodes")
    bits = nodes.select("node", *fps)
    kept: list[DataFrame] = []
    indexed: list[DataFrame] = []

    def sets_of(need: DataFrame) -> DataFrame:
        needed = materialize(nodes.join(need, F.col("node") == F.col("need"), "left_semi").select("node", F.col("rep").alias("rep_"), F.col("digest").alias("digest_")), "copies-needed")
        said = worded.join(needed, F.col("id").eqNullSafe(F.col("rep_")) & (F.col("digest") == F.col("digest_"))).select("node", "text")
        sets = materialize(said.mapInArrow(_shingle_sets(width), "node long, shingles array<long>").dropDuplicates(["node"]), "copies-sets")
        kept.extend([needed, sets])
        return sets

    def verify(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            own = bits.select(F.col("node").alias(f"n_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in fps])
            pairs = pairs.join(own, F.col(side) == F.col(f"n_{side}"))
        apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in fps), F.lit(0))
        near = materialize(pairs.where(apart <= MOST_BITS).select("a", "b"), "copies-pairs")
        kept.append(near)
        sets = indexed[0] if indexed else sets_of(near.select(F.col("a").alias("need")).union(near.select("b")).distinct())
        for side in ("a", "b"):
            near_ = near if side == "a" else both
            both = near_.join(sets.select(F.col("node").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}")), F.col(side) == F.col(f"n_{side}"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        return both.where(common >= F.lit(similarity) * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")

    def index(some: DataFrame) -> DataFrame:
        indexed.append(sets_of(some.select(F.col("node").alias("need"))))
        return rarest_shingles(indexed[0], similarity)

    def could(x: str, y: str) -> Column:
        """Whether the shingles from a common one on are enough: a pair's rarest common shingle has all others behind it."""
        left = F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col(f"{y}.size") - F.col(f"{y}.at"))
        return (1 + similarity) * left >= similarity * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-6

    labels, used = linked(variants(bits, fps), verify, index, could)
    named = nodes.join(labels.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("digest", "rep", F.coalesce("component", "node").alias("root"))
    least = named.groupBy(F.col("root").alias("root_")).agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, F.col("root") == F.col("root_")).select(F.col("digest").alias("of"), "component_id"), "copies-named")
    discard(nodes, *used, *kept)
    return rows.join(named, F.col("digest") == F.col("of")).select("id", "digest", "component_id")


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for text in b.column(1).to_pylist():
                words = word_hashes(text.encode().lower())
                sets.append(np.unique(run_hashes(words, min(width, len(words)))).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["node", "shingles"])

    return run


def rarest_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size, at) of those rarest shingles of each of sets (node, shingles) of which two similar ones share one.

    at: how many of the node's size shingles are rarer (by number of nodes that have it, then by hash).  The rarest
    common shingle of two sets has all other common ones behind it in both, so it is among those that leave at
    least similarity * size.
    """
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    often = each.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(often.hint("shuffle_hash"), F.col("key") == F.col("k"))
    own = Window.partitionBy("node")
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "key")) - 1
    placed = shared.select("key", "node", "size", at.alias("at"))
    return placed.where(F.col("size") - F.col("at") >= similarity * F.col("size") - 1e-6)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that are near copies: of each component of near_copies() the row with the smallest id stays.

    Rows with a null id, rows without any word (null and empty texts) and rows that repeat the smallest id itself stay.
    Ties and extra columns change nothing; an empty table gives an empty result.
    """
    found = near_copies(docs, id_col, text_col, width, similarity)
    gone = materialize(found.where("id IS NOT NULL AND id <> component_id").select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), "copies-gone")
    same = (docs[id_col] == gone["gone_id"]) & (F.unhex(F.md5(docs[text_col].cast("binary"))) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti")
