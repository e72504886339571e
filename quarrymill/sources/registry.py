"""The registry of ingested documents: identity by content hash, status of new arrivals, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, filename string, source_path string, size_bytes long, ingested_at timestamp, hash string"


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(content.cast("binary"), 256)


def status(arrivals: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """arrivals (filename, hash) with status: a known hash is UNCHANGED, else a known name is MODIFIED, else NEW.

    force takes all as NEW.  The registry is reduced to distinct hashes and names before it is joined.
    """
    if force:
        return arrivals.withColumn("status", F.lit("NEW"))
    hashes = registry.select("hash").distinct().withColumn("_h", F.lit(True))
    names = registry.select("filename").distinct().withColumn("_n", F.lit(True))
    joined = arrivals.join(hashes, "hash", "left").join(names, "filename", "left")
    kind = F.when(F.col("_h"), "UNCHANGED").when(F.col("_n"), "MODIFIED").otherwise("NEW")
    return joined.withColumn("status", kind).select(*arrivals.columns, "status")


def upsert(registry: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The registry after arrivals: their rows replace those with their hash, and older ones with their name."""
    new = arrivals.dropDuplicates(["hash"])
    kept = registry.join(new.select("hash"), "hash", "left_anti").join(new.select("filename").distinct(), "filename", "left_anti")
    return kept.select(*registry.columns).unionByName(new.select(*registry.columns))


def superseded(registry: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Rows of the registry that upsert() drops as older versions: whose chunks and vectors should go too."""
    fresh = arrivals.select("filename", F.col("hash").alias("new_hash")).distinct()
    return registry.join(fresh, "filename").where("hash <> new_hash").select(*registry.columns).distinct()


def summary(arrivals: DataFrame, registry: DataFrame, supported: Column, failed: Column | None = None) -> DataFrame:
    """(outcome, n_files): new, re-ingested, unchanged, unsupported, failed."""
    told = status(arrivals, registry)
    kind = F.when(~supported, "unsupported").when(F.lit(False) if failed is None else failed, "failed").when(F.col("status") == "UNCHANGED", "unchanged").when(F.col("status") == "MODIFIED", "re-ingested").otherwise("new")
    return told.select(kind.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n_files"))


def known(registry: DataFrame, hashes: DataFrame) -> DataFrame:
    return hashes.join(registry.select("hash").distinct(), "hash", "left_semi")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The registry's JSON lines; malformed ones are left out, a missing one is an empty registry, and one left between the two
    renames of save() is read where that kept it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.old")):
        path = f"{path}.old"
    try:
        rows = spark.read.schema(f"{SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        return rows.where("_corrupt IS NULL AND hash IS NOT NULL AND doc_id IS NOT NULL").drop("_corrupt")
    except Exception as e:  # the reader reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def save(registry: DataFrame, path: str) -> None:
    """Writes beside the old registry and swaps; the old one is kept until the new one is in place."""
    spark = registry.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    registry.write.mode("overwrite").json(f"{path}.new")
    kept = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(kept, True)
    if fs.exists(old):
        fs.rename(old, kept)  # load() falls back on it if this process ends before the next line
    fs.rename(new, old)
    fs.delete(kept, True)
