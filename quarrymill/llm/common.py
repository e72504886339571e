"""Shared pieces of the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as a shuffle has, for a step that makes many rows of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by materialize() that no lazy plan reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash: equal for equal edge sets."""
    got = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return got["n"], got["h"] or 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in MapReduce
    and beyond"), each a grouped minimum and a join, until the edges are stars around their minima.
    Every step is written to the shared folder.  Nodes may be of any ordered type; nulls and loops are ignored.
    """
    a, b = F.col(left), F.col(right)
    cur = materialize(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")), "cc")
    seen = fingerprint(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = materialize(both.groupBy(F.col("hi").alias("k")).agg(F.min(F.least("hi", "lo")).alias("m")), "cc-min")
        # each edge gives one at most, so repeats need not be dropped here
        large = materialize(both.where("lo > hi").join(least, F.col("hi") == F.col("k")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")), "cc-large")
        low = materialize(large.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m")), "cc-low")
        small = large.join(low, F.col("hi") == F.col("k")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        nxt = materialize(small.union(low.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).distinct(), "cc")
        now = fingerprint(nxt)
        discard(cur, least, large, low)
        cur = nxt
        if now == seen:
            break
        seen = now
    stars = cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def free_name(df: DataFrame, base: str) -> str:
    """A column name like base that df doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
