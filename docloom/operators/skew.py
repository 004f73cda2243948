"""Joins and top-k built for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join whose big side is spread over ``salts`` tasks per key.

    The small side is repeated once per salt. Valid for inner, left, left_semi and
    left_anti joins, where every big row needs its partners exactly once.

    The copies come from a join with the salts, not from ``explode``: Spark counts its rows in
    the estimate, so a small side is broadcast only if all its copies are small together.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting does not preserve a {how} join")
    spread = spread_by or [c for c in big.columns if c not in on] or list(big.columns)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.crossJoin(small.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key, rank from 1.

    The rank filter becomes a WindowGroupLimit, so every map task already keeps at most
    ``k`` rows of a key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The single best row per key."""
    return top_k(df, keys, order, 1, "_best").drop("_best")
