"""Store writers: upserts, the three-table ingest write, text and record sinks.

Stores are Parquet folders partitioned by a hash bucket of their key; an upsert rewrites
into a fresh folder, so a lost executor never leaves a half-written store.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.search import postings, tokenize
from docloom.operators.skew import best_row


def latest_by_key(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both with the newest row per key; at equal order the incoming row wins."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return best_row(both, [key], [F.desc(order), F.desc("_in")]).drop("_in")


def write_store(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Parquet partitioned by key bucket; salted inside, so a hot bucket has several writers."""
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    spread = F.pmod(F.xxhash64(*df.columns[:4]), F.lit(8))
    keyed.repartition("bucket", spread).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def ingest_tables(chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """The three stores of an ingest: chunk rows, vectors, and postings."""
    words = tokenize(chunks, "chunk_id", "content")
    return {"chunks": chunks, "vectors": vectors, "postings": postings(words, "chunk_id")}


def write_ingest(tables: Mapping[str, DataFrame], folder: str, keys: Mapping[str, str] | None = None, buckets: int = 64) -> DataFrame:
    """Write all stores and report the stored rows per store, read back from the files."""
    keys = keys or {"chunks": "chunk_id", "vectors": "chunk_id", "postings": "term"}
    counts = None
    for name, df in tables.items():
        write_store(df, f"{folder}/{name}", keys[name], buckets)
        stored = df.sparkSession.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("store"), F.count("*").alias("rows"))
        counts = stored if counts is None else counts.unionByName(stored)
    return counts


def valid_records(rows: DataFrame, raw: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Parsed JSON rows in which every required field is present."""
    parsed = rows.withColumn("_r", F.from_json(raw, schema))
    present = F.col("_r").isNotNull()
    for field in required:
        present = present & F.get_json_object(F.col(raw), f"$.{field}").isNotNull()
    return parsed.where(present).drop("_r")


def records(instruction: str, question: Column, output: Column) -> list[Column]:
    """Columns of an instruction record."""
    return [F.lit(instruction).alias("instruction"), F.concat(F.lit("查询："), question).alias("input"), output.alias("output")]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
