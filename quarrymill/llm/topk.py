"""Exact top-k search by aggregation without random access (NRA) over sorted lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import discard, materialize

CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048
#: Survivors at which reading stops and their scores are resolved.
SHORT_LIST = 128
#: Of each query's lists, by falling weight: the share read to the end after each round; as many again are read to the middle.
READ_SHARES = (0.1, 0.4, 0.6, 0.8, 1.0)
#: Queries whose bounds are held at once.
BATCH = 256


class SortedLists:
    """One list for each dimension: a block's candidates by falling value, entered from either end.

    A query reads list i from the end where its own component makes scores high, heavier components first.  Nothing is
    looked up out of turn: a candidate's score so far sums what was read of it.  Of what is unread, each list's last
    value read and far end bound the part of one component, and the norm left (an entry carries its candidate's) the part
    of all of them together.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n, width = vectors.shape
        ordered = np.sort(vectors, axis=0)
        self.far = (ordered[0], ordered[-1])
        self.middle = (ordered[n - max(1, n // 2)], ordered[max(1, n // 2) - 1])  # last value of the upper and of the lower half
        upper, lower = np.where(vectors >= self.middle[0], vectors, 0), np.where(vectors <= self.middle[1], vectors, 0)
        self.read = np.concatenate([vectors, upper, lower], axis=1)
        self.norm2 = (vectors.astype(np.float64) ** 2).sum(1)
        self.read2 = (self.read.astype(np.float64) / max(1.0, np.sqrt(self.norm2.max(initial=0)))).astype(np.float32) ** 2  # of the longest
        self.shares_read: list[float] = []

    def bounds(self, queries: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) scores of candidates by queries once that share of the lists is read to the end."""
        width = queries.shape[1]
        whole = min(width, -(-int(share * 1000) * width // 1000))
        rank = np.argsort(np.argsort(-np.abs(queries), axis=1, kind="stable"), axis=1)
        full, half = rank < whole, (rank >= whole) & (rank < 2 * whole)
        plus, minus = half & (queries > 0), half & (queries < 0)
        partial = self.read @ np.concatenate([queries * full, queries * plus, queries * minus], axis=1).T
        if whole == width:
            return partial, partial
        q = queries.astype(np.float64)
        ends = (q * self.far[0], q * self.far[1])
        best, worst = np.maximum(*ends), np.minimum(*ends)
        last = np.where(q > 0, q * self.middle[0], q * self.middle[1])  # the most an entry beyond the middle can add
        high = (best * ~(full | half)).sum(1) + (np.maximum(last, 0) * half).sum(1)
        low = (worst * ~(full | half)).sum(1) + (np.minimum(worst, 0) * half).sum(1)
        high, low = high + 1 + 1e-6 * np.abs(high), low - 1 - 1e-6 * np.abs(low)
        scale = np.float32(max(1.0, self.norm2.max(initial=0)))
        left = self.read2 @ np.concatenate([full, plus, minus], axis=1).astype(np.float32).T
        # the margin is far above what single precision loses
        left = np.sqrt(np.maximum((self.norm2 / scale).astype(np.float32)[:, None] - left, 0) + np.float32(1e-4))
        left *= (np.sqrt(scale * (q * q * ~full).sum(1)) * 1.001 + 1e-3).astype(np.float32)
        return partial + np.maximum(low.astype(partial.dtype), -left), partial + np.minimum(high.astype(partial.dtype), left)

    def best(self, queries: np.ndarray, k: int, banned: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (positions, scores) of all candidates whose inner product reaches the k-th highest.

        A candidate whose upper bound falls below the k-th highest lower bound is out; a query is closed when few are
        left, and their scores resolved.  banned: positions that are no candidates of a query.
        """
        n = len(self.vectors)
        out: list = [None] * len(queries)
        open_now = np.arange(len(queries))
        for share in (READ_SHARES if n > max(k, SHORT_LIST) else (1.0,)):
            if not len(open_now):
                break
            lower, upper = self.bounds(queries[open_now], share)
            for j, i in enumerate(open_now.tolist()):
                if banned is not None and len(banned[i]):
                    lower[banned[i], j] = upper[banned[i], j] = -np.inf
            least = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(open_now), -np.inf)
            may = (upper >= least) & (upper > -np.inf)
            closed = (may.sum(0) <= SHORT_LIST) | (share == READ_SHARES[-1])
            for j in np.flatnonzero(closed):
                at = np.flatnonzero(may[:, j])
                scores = self.vectors[at] @ queries[open_now[j]]
                if len(at) > k:
                    on = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    at, scores = at[on], scores[on]
                out[open_now[j]] = (at, scores)
            self.shares_read += [share + min(share, 1 - share) / 2] * int(closed.sum())
            open_now = open_now[~closed]
        return out


def _exact_scores(vectors: np.ndarray, queries: np.ndarray, k: int, banned: list[np.ndarray]) -> list[tuple[np.ndarray, list[int]]]:
    """As SortedLists.best() for components so large that floating sums are not exact: plain integers, held to the range of a long."""
    out = []
    wide = vectors.astype(object)
    for q, no in zip(queries.astype(object), banned, strict=True):
        at = np.setdiff1d(np.arange(len(wide)), no)
        scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in wide[at] @ q] if len(at) else []
        least = sorted(scores)[-k] if len(scores) > k else None
        keep = [i for i, s in enumerate(scores) if least is None or s >= least]
        out.append((at[keep], [scores[i] for i in keep]))
    return out


def _search(block: pa.Table, k: int) -> pa.Table:
    """The best k candidates (ties by id) of one block for each query of one block."""
    is_query = np.array(block.column("is_query").to_pylist(), bool)
    rows = block.column("vector").combine_chunks()
    width = len(rows[0])
    whole = np.asarray(rows.flatten()).reshape(-1, width)
    large = max(-int(whole.min(initial=0)), int(whole.max(initial=0)))
    plain = large * large * width < 2**53
    vectors = whole.astype(np.float32 if large * large * width < 2**24 else np.float64) if plain else whole  # sums stay exact
    keys = np.asarray(block.column("key"))
    ids, owners = block.column("ids").to_pylist(), block.column("own").to_pylist()
    places, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    alone: dict[int, list[int]] = {}
    for at, p in enumerate(places.tolist()):
        if len(ids[p]) == 1:
            alone.setdefault(ids[p][0], []).append(at)
    out_key, out_id, out_score = [], [], []
    if len(places):
        lists = SortedLists(vectors[places]) if plain else None
        for start in range(0, len(asked), BATCH):
            some = asked[start : start + BATCH]
            banned = [np.array(alone.get(owners[i], []) if owners[i] is not None else [], np.int64) for i in some]
            found = lists.best(vectors[some], k, banned) if plain else _exact_scores(vectors[places], vectors[some], k, banned)
            for i, (left, scores) in zip(some, found, strict=True):
                first = sorted((-int(s), v) for p, s in zip(left.tolist(), scores, strict=True) for v in ids[places[p]] if v != owners[i])[:k]
                out_key += [keys[i]] * len(first)
                out_id += [v for _, v in first]
                out_score += [-s for s, _ in first]
    return pa.table({"key": pa.array(out_key, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.int64())})


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, query_step: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest integer inner products for every row whose id query_step divides.

    A component x becomes floor(scale * x).  Candidates are all rows but those of the query's own id; ties go to the
    smaller id; with fewer than k candidates all are returned.  Vectors that are null, empty or hold null or
    non-finite components take no part, nor do null ids and vectors with a component that no long holds.  Rows with one
    id and one vector count once; an id with several vectors asks with each of them and meets none of its own.
    Scores beyond a long are held to its range.  Vectors meet only others of their length.  Other columns are not
    read.  An empty table gives an empty result.

    Equal vectors are one candidate that keeps its k + 1 smallest ids, and one query unless their id has several vectors, so
    a vector that holds a third of the rows costs no more than another.  Candidates and queries are cut into hashed blocks; each pair of blocks is a
    task of bounded size; best lists of the blocks are merged by rank.
    """
    wide = F.transform(vector_col, lambda x: F.lit(scale) * x.cast("double"))
    fits = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * F.lit(scale)) >= F.lit(2.0**62)))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & fits).select(F.col(id_col).cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x).cast("long")).alias("vector"))
    first = Window.partitionBy("vector").orderBy("id")
    kept = rows.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    classes = kept.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(F.col("id") % query_step == 0).distinct()
    several = asked.groupBy(F.col("id").alias("id_")).agg(F.count("*").alias("n")).where("n > 1").select("id_", F.col("id_").alias("own"))
    asked = materialize(asked.join(several, F.col("id") == F.col("id_"), "left").select("id", "own", "vector"), "topk-asked")
    classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()), "topk-classes")
    queries = materialize(asked.select("own", "vector").distinct().withColumn("key", F.monotonically_increasing_id()), "topk-queries")
    n_c = max(1, math.ceil(classes.count() / CANDIDATE_BLOCK))
    n_q = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    shape = F.size("vector").alias("width")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vector"), F.lit(n)).cast("int")
    left = classes.select(shape, block(n_c).alias("cb"), many(n_q).alias("qb"), F.lit(False).alias("is_query"), "key", "vector", "ids", F.lit(None).cast("long").alias("own"))
    right = queries.select(shape, many(n_c).alias("cb"), F.pmod("key", F.lit(n_q)).cast("int").alias("qb"), F.lit(True).alias("is_query"), "key", "vector", F.lit(None).cast("array<long>").alias("ids"), "own")
    grid = left.union(right).groupBy("width", "cb", "qb").applyInArrow(lambda t: _search(t, k + 1), "key long, vec_id long, score long")
    best = grid.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    lists = materialize(lists.join(queries, "key").select(F.col("vector").alias("of"), F.col("own").alias("of_own"), "found"), "topk-lists")
    own = asked.join(lists, (F.col("vector") == F.col("of")) & F.col("own").eqNullSafe(F.col("of_own"))).select("id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k).alias("found"))
    discard(classes, queries)
    flat = own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("pos", "f"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
