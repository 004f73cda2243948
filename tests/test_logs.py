"""Log analytics on many rows."""

from pyspark.sql import functions as F

from docloom.operators import logs


def test_kpi_percentiles_are_exact_on_many_latencies(spark):
    n = 300_000
    rows = spark.range(n).select(
        (F.col("id") * 7919 % n + 1).alias("total_time"), F.lit("fast").alias("lane"), F.lit(0).alias("retry_count"), F.lit(False).alias("clarified"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("kind"),
    )
    got = {(r["kind"], r["queries"]): [r["p50"], r["p95"], r["p99"]] for r in logs.query_kpis(rows, "kind").collect()}
    assert got[None, n] == [150_000, 285_000, 297_000]
    assert set(got) == {(None, n), (None, n // 3), ("a", n // 3), ("b", n // 3)}
    assert [r["p50"] for r in logs.query_kpis(rows).collect()] == [150_000]
