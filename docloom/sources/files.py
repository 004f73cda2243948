"""File sources: hashed directory scans and incremental skips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with content hash: rows (path, name, length, modified, file_hash, content)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("file_hash"), "content",
    )


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not known yet; of equal files the first path stays."""
    first = files.groupBy("file_hash").agg(F.min("path").alias("path"))
    return files.join(first, ["file_hash", "path"], "left_semi").join(known.select("file_hash").distinct(), "file_hash", "left_anti")


def ingest_report(files: DataFrame, known: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Status per file: ingested, duplicate, or failed; a status column, no exceptions."""
    fresh = new_files(files, known).select("path").withColumn("_new", F.lit(True))
    rows = files.select("path", "name", "file_hash").join(fresh, "path", "left")
    bad = F.lit(None).cast("boolean")
    if failed is not None:
        rows = rows.join(failed.select("path").distinct().withColumn("_bad", F.lit(True)), "path", "left")
        bad = F.col("_bad")
    status = F.when(F.col("_new").isNull(), "duplicate").when(bad, "failed").otherwise("ingested")
    return rows.select("path", "name", "file_hash", status.alias("status"))


def not_ingested(batch: DataFrame, done: DataFrame, standard: str = "standard_no", title: str = "doc_title") -> DataFrame:
    """Batch rows whose standard number, or title when there is no number, is not stored yet."""
    key = F.coalesce(F.nullif(F.col(standard), F.lit("")), F.col(title))
    stored = done.select(F.explode(F.array(standard, title)).alias("_k")).where(F.coalesce("_k", F.lit("")) != "").distinct()
    return batch.withColumn("_k", key).join(stored, "_k", "left_anti").drop("_k")
