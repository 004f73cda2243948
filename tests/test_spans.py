"""Positions of words inside their line."""

from pyspark.sql import functions as F

from docloom.sources.tables import Corpus, sums_before


def test_sums_before(spark):
    rows = spark.createDataFrame([(1, []), (2, [5]), (3, [1, 2, 3]), (4, list(range(1000)))], "id int, a array<long>")
    got = {r["id"]: r["s"] for r in rows.select("id", sums_before(F.col("a")).alias("s")).collect()}
    assert got == {1: [], 2: [0], 3: [0, 1, 3], 4: [i * (i - 1) // 2 for i in range(1000)]}


def test_spans_are_numbered_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(7, "one two  three\nfour")], "doc_id long, text string").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = Corpus(spark, str(tmp_path))
    c._splits["documents"] = 1 << 10  # as if it had enough splits to be read as it is
    spans = c.spans()
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    rows = {(r["block_idx"], r["span_idx"]): (r["content"], r["x1"] - r["x0"], r["x0"]) for r in spans.collect()}
    start = rows[0, 0][2]
    assert [rows[0, i][2] - start for i in range(4)] == [0, 18, 36, 39] and rows[0, 2][:2] == ("", 0) and rows[1, 0][0] == "four"
