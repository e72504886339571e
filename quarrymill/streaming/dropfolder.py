"""The drop folder as a stream: what arrives is hashed, told apart from what is known, and registered, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.sources import registry
from quarrymill.sources.selection import PROCESSED, supported

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(path, filename, size_bytes, hash, content) of supported files, as they come."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    fit = files.where(supported(F.col("path")) & ~F.contains("path", F.lit(f"/{PROCESSED}/")))
    return fit.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size_bytes"), registry.content_hash(F.col("content")).alias("hash"), "content")


def ingest_stream(spark: SparkSession, folder: str, registry_path: str, checkpoint: str, handle: Callable[[DataFrame], None]) -> StreamingQuery:
    """Processes what is there and stops.  handle gets each batch's new and modified files with their status.

    The registry is written after handle; a batch that is run again after a failure finds its files registered or not at all.
    """

    def batch(rows: DataFrame, _: int) -> None:
        known = registry.load(spark, registry_path)
        told = registry.status(rows.dropDuplicates(["hash"]), known).where("status <> 'UNCHANGED'").cache()
        handle(told)
        entries = told.select(F.col("hash").alias("doc_id"), "filename", F.col("path").alias("source_path"), "size_bytes", F.current_timestamp().alias("ingested_at"), "hash")
        registry.save(registry.upsert(known, entries), registry_path)
        told.unpersist()

    return arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type, with late data dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
