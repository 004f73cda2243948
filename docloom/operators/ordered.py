"""Ordered scans (running sums, carry-forward, previous row) that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends every row of a key to one task.
Here a key is cut into position buckets: rows scan inside their bucket, one summary row
per bucket is scanned across buckets, and the carried value is joined back. A key with a
third of all rows is therefore spread over as many tasks as it has buckets, and only
1/bucket-size of its rows meet in the small scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def position_bucket(position: Column | str, size: int = 4096) -> Column:
    """Bucket number of an integer position; monotone in the position."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    fills: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    maxes_before: Mapping[str, Column] | None = None,
    fills_before: Mapping[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ordered-scan columns.

    ``sums``/``maxes`` include the current row; ``maxes_before``/``fills_before`` stop at
    the row before it. ``fills`` is the latest non-null value up to the row, ``previous``
    the value of the row before (nulls kept). ``bucket`` must be monotone in ``order``.
    """
    sums, maxes, fills = sums or {}, maxes or {}, fills or {}
    previous, maxes_before, fills_before = previous or {}, maxes_before or {}, fills_before or {}
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    order_cols = [direction(c) for c in order]

    work = df.withColumn(BUCKET, bucket)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order_cols)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    # One boxed struct per value keeps "no row yet" apart from "a row holding null".
    local = work.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.max(c).over(upto).alias(f"_l_{n}") for n, c in maxes.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_l_{n}") for n, c in fills.items()],
        *[F.last(F.struct(c.alias("v"))).over(before).alias(f"_l_{n}") for n, c in previous.items()],
        *[F.max(c).over(before).alias(f"_l_{n}") for n, c in maxes_before.items()],
        *[F.last(c, ignorenulls=True).over(before).alias(f"_l_{n}") for n, c in fills_before.items()],
    )

    position = F.struct(*order)
    latest = F.min_by if descending else F.max_by
    summaries = work.groupBy(*keys, BUCKET).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_s_{n}") for n, c in [*maxes.items(), *maxes_before.items()]],
        *[
            latest(c, F.when(c.isNotNull(), position)).alias(f"_s_{n}")
            for n, c in [*fills.items(), *fills_before.items()]
        ],
        *[latest(F.struct(c.alias("v")), position).alias(f"_s_{n}") for n, c in previous.items()],
    )
    bucket_order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    earlier = (
        Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summaries.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BUCKET).alias("_k_bucket"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in [*maxes, *maxes_before]],
        *[
            F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}")
            for n in [*fills, *fills_before, *previous]
        ],
    )
    condition = F.col(BUCKET) == F.col("_k_bucket")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carried, condition, "left")

    out = []
    for n in sums:
        inside_sum, carried_sum = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        out.append(F.coalesce(inside_sum + carried_sum, inside_sum, carried_sum).alias(n))
    for n in [*maxes, *maxes_before]:
        out.append(F.greatest(f"_l_{n}", f"_c_{n}").alias(n))
    for n in [*fills, *fills_before]:
        out.append(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n))
    for n in previous:
        out.append(F.coalesce(f"_l_{n}", f"_c_{n}")["v"].alias(n))
    return joined.select(*df.columns, *out)


def following(df: DataFrame, keys, order, bucket, values: Mapping[str, Column]) -> DataFrame:
    """Value of the next row (the mirror of ``previous``)."""
    return scan(df, keys, order, bucket, previous=values, descending=True)
