"""Tables of the engine on disk: chunks, vectors and metadata as Parquet; JSON for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.session import written

BUCKETS = 64


def write_chunks(chunks: DataFrame, path: str, by_document: int | None = BUCKETS) -> None:
    """Parquet, partitioned by a bucket of the document's hash, so one document's chunks are one small read."""
    out = chunks.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(by_document)).cast("int")) if by_document else chunks
    writer = out.repartition(by_document, "doc_bucket").write.partitionBy("doc_bucket") if by_document else out.write
    writer.mode("overwrite").parquet(path)


def _present(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def replace_documents(rows: DataFrame, path: str, by_document: int = BUCKETS) -> None:
    """Rows take the place of the stored rows of their documents; those of all other documents stay.

    Only the buckets of these documents are rewritten, each from what it held and the new rows, which are written aside first.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(by_document)).cast("int")
    new = written(rows, "replacing")
    if _present(spark, path):
        docs = new.select("doc_id").distinct()
        touched = docs.select(bucket.alias("doc_bucket")).distinct()
        stay = spark.read.parquet(path).join(F.broadcast(touched), "doc_bucket", "left_semi").join(docs, "doc_id", "left_anti")  # at most a row for each bucket
        new = written(stay.drop("doc_bucket").unionByName(new, allowMissingColumns=True), "replacing")
    out = new.withColumn("doc_bucket", bucket).repartition(by_document, "doc_bucket")
    out.write.partitionBy("doc_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def add_rows(rows: DataFrame, path: str, by_document: int = BUCKETS) -> None:
    """Rows beside the stored ones, in the buckets of their documents."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(by_document)).cast("int")
    rows.withColumn("doc_bucket", bucket).repartition(by_document, "doc_bucket").write.partitionBy("doc_bucket").mode("append").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored rows; None where nothing is stored."""
    return spark.read.parquet(path).drop("doc_bucket") if _present(spark, path) else None


def read_chunks(spark: SparkSession, path: str, doc_id=None, by_document: int | None = BUCKETS) -> DataFrame:
    """All chunks, or one document's from its bucket alone."""
    chunks = spark.read.parquet(path)
    if doc_id is None:
        return chunks.drop("doc_bucket")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id).cast(kind)), F.lit(by_document)).cast("int")).first()[0]
    return chunks.where((F.col("doc_bucket") == bucket) & (F.col("doc_id") == doc_id)).drop("doc_bucket")


def dropped_empties(chunks: DataFrame) -> DataFrame:
    """Empty strings, empty lists, false and 0 as null, which JSON leaves out."""
    cols = []
    for f in chunks.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit(True))
        elif isinstance(f.dataType, T.NumericType) and f.name not in ("tier", "ord", "token_count"):
            c = F.when(c != 0, c)
        cols.append(c.alias(f.name))
    return chunks.select(*cols)


def write_json(chunks: DataFrame, path: str) -> None:
    dropped_empties(chunks).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Chunks from JSON; what is missing takes the type's empty value."""
    raw = spark.read.schema(schema).json(path)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """One row for each query of a golden JSON file; without a list of queries it is an error; comment entries are left out."""
    raw = spark.read.option("multiLine", "true").json(path)
    if "queries" not in raw.columns or not isinstance(raw.schema["queries"].dataType, T.ArrayType):
        raise ValueError(f"{path} has no list of queries")
    rows = raw.select(F.posexplode("queries").alias("at", "q")).select((F.col("at") + 1).alias("query_id"), "q.*")
    return rows.where("query IS NOT NULL")
