"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import discard, free_name, materialize, text_or_empty

def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count items of one size go to each shard if each in turn goes to the least-loaded (ties: the lowest).

    The next item goes to the smallest of (load + items given * size, shard), so the items given are the count smallest
    of these over all shards: all below a level, found by bisection, and at the level the lowest shards first.
    """
    given = lambda level: sum(-(-(level - x) // size) for x in loads if x < level)
    lo, hi = min(loads), max(loads) + size * (count // len(loads) + 1) + 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if given(mid) <= count else (lo, mid - 1)
    out = [-(-(lo - x) // size) if x < lo else 0 for x in loads]
    heap = [(x + n * size, s) for s, (x, n) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        _, s = heapq.heappop(heap)
        out[s] += 1
    return out


def schedule(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Longest processing time first over runs (size, number of items of it): (size, shards, items up to and with each).

    Items go by falling size to the least-loaded shard of a heap.  Items of one size are interchangeable, so a run of many
    is dealt at once.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sorted(runs, reverse=True):
        if count < 4 * shards or size < 1:
            took: dict[int, int] = {}
            for _ in range(count if size else 1):
                load, s = heapq.heappop(heap)
                took[s] = took.get(s, 0) + (1 if size else count)
                heapq.heappush(heap, (load + size, s))
        else:
            loads = [x for x, _ in sorted(heap, key=lambda x: x[1])]
            got = deal(loads, size, count)
            took = {s: n for s, n in enumerate(got) if n}
            heap = [(x + n * size, s) for s, (x, n) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
        yield size, list(took), list(accumulate(took.values()))


def _numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with name: each row's place from 0 among those of its key.  Counted by file first, so no key meets in one task.

    df is a written table with row_no: monotonically_increasing_id() of the write.
    """
    df = df.withColumn("part_", F.shiftrightunsigned("row_no", 33))
    before = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(key, "part_").agg(F.count("*").alias("n")).select(F.col(key).alias("k_"), F.col("part_").alias("p_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))
    within = F.row_number().over(Window.partitionBy(key, "part_").orderBy("row_no")) - 1
    counted = df.withColumn("within_", within).join(cells, (F.col(key) == F.col("k_")) & (F.col("part_") == F.col("p_")))
    return counted.withColumn(name, (F.col("base_") + F.col("within_")).cast("long")).drop("part_", "k_", "p_", "base_", "within_")


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each row of docs: (id_col, size, text_crc32, law, shard, grown_shard, slot), by the law `bytes`.

    Rows with equal texts are one group and share a shard; a null text counts as an empty one.  size: UTF-8 bytes of
    the text plus overhead.  All groups, by falling size, go to the least-loaded shard; groups of one size are
    interchangeable, so the driver schedules (size, number of groups) pairs.  There are at most the square root of twice
    all bytes of them, and in practice far fewer.  A group larger than a fair share still stays together, so its shard
    is larger.  Slots are gapless from 0 in each shard.  Repeated rows and null ids get a
    slot each.  Other columns are not read.  An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    if overhead < 1:
        raise ValueError("a row takes a byte at least")
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.md5(text.cast("binary"))).alias("grp"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.withColumn("row_no", F.monotonically_increasing_id()), "shard-groups")
    runs = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    found = list(schedule(zip(runs["bytes"].to_pylist(), runs["n"].to_pylist(), strict=True), shards))
    cols = list(zip(*found, strict=True)) or [[], [], []]
    plan = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["of_bytes", "to", "upto"]))
    nth = F.size(F.filter("upto", lambda x: x <= F.col("nth"))) + 1
    homes = _numbered(groups, "bytes", "nth").join(plan, F.col("bytes") == F.col("of_bytes")).select(F.col("grp").alias("home_of"), F.element_at("to", nth).alias("shard"))
    placed = rows.join(homes, F.col("grp") == F.col("home_of")).select("id", "size", "crc", "shard", F.monotonically_increasing_id().alias("row_no"))
    placed = materialize(placed, "shard-placed")
    discard(rows, groups)
    return _numbered(placed, "shard", "slot").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs under path, one folder shard=N for each shard.  Ids must be unique and not null."""
    name = free_name(docs, "shard")
    placed = assign_shards(docs, shards, id_col, text_col).select(F.col(id_col).alias("placed_id"), F.col("shard").alias(name))
    joined = docs.join(placed, docs[id_col] == F.col("placed_id")).drop("placed_id")
    joined.repartition(shards, name).write.partitionBy(name).parquet(path)
