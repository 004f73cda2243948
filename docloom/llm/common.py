"""Helpers shared by the corpus operators: table access, staging, row ids, group joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import shared_dir

#: A group that holds more than this share of all rows is spread over salts; there are at most 1 / share of them.
HOT_SHARE = 1 / 1000
HOT_SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name like ``base`` that no column of ``taken`` has, whatever its case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Every executor can reach the files, so a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` under a name that says what it is here: one bounded batch after another."""
    return df.mapInArrow(work, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def first_row_id() -> int:
    """First of the row ids that the running task may give out."""
    return TaskContext.get().partitionId() << 33


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """Each row with the columns of its group, also where one group holds a third of all rows.

    Groups over ``HOT_SHARE`` of ``total`` rows, at most ``1 / HOT_SHARE`` of them, are shipped
    as a list of keys; their rows are dealt over salts by ``spread``. All others join by key.
    """
    cut = max(int(total * HOT_SHARE), 1)
    hot = F.broadcast(groups.where(F.col(size) > cut).select(key, F.lit(HOT_SALTS).alias("_salts")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    salts = F.when(F.col(size) > cut, F.lit(HOT_SALTS)).otherwise(F.lit(1))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "_salt"]).drop("_salt")


def fields(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with further columns."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more)])
