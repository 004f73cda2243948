"""Lookups of many questions that ask for the same: rows that pass through the joins stay few."""

from pyspark.sql import functions as F

from docloom.operators import lookup, tool_plan


def most_rows(spark, df):
    """Rows of ``df``, and the largest number of rows that left one node of its plan."""
    rows = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    nodes, values, most = store.planGraph(last).allNodes(), store.executionMetrics(last), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size()):
            m = metrics.apply(j)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows, most


def test_related_documents_are_ranked_once_per_keyword(spark):
    n = 1000
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("red").alias("keyword"), F.when(F.col("id") % 2 == 0, "B").alias("category"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a red one").alias("title"), F.when(F.col("id") % 4 == 3, "B").otherwise("A").alias("category"), F.lit("completed").alias("process_status"))
    rows, most = most_rows(spark, lookup.related_documents(asked, docs, ["title"]))
    found = {(r["query_id"] % 2, r["rank"], r["doc_id"]) for r in rows}
    assert len(rows) == 10 * n and found == {(1, i + 1, i) for i in range(10)} | {(0, i + 1, 4 * i + 3) for i in range(10)}
    assert most < n * n / 4


def test_tables_are_found_once_per_keyword(spark):
    n = 1000
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit("T1"), F.concat(F.lit("T1x"), F.col("id").cast("string"))).alias("w"))
    tables = spark.range(n).select(F.col("id").alias("table_id"), F.lit("a").alias("title"), F.lit("T1").alias("table_number"))
    found, missing = lookup.find_tables(asked, tables, F.col("w"))
    rows, most = most_rows(spark, found)
    assert {(r["rank"], r["table_id"]) for r in rows} == {(i + 1, i) for i in range(5)} and len(rows) == 5 * n and most < n * n / 4
    assert missing.count() == 0


def test_chunks_are_rated_once_per_wording_and_clauses_found_once(spark):
    n = 1000
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("red high").alias("query"), F.array(F.lit("S")).alias("standards"), F.lit("S").alias("standard_no"), F.lit("1").alias("clause"))
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("S").alias("standard_no"), F.lit("1").alias("clause"), F.when(F.col("id") < 20, "red").otherwise("high red").alias("content"), F.lit(None).cast("int").alias("position"))
    rows, most = most_rows(spark, tool_plan.in_standards(asked.drop("standard_no", "clause"), chunks))
    assert {(r["rank"], r["chunk_id"], r["score"]) for r in rows} == {(i + 1, 20 + i, 1.0) for i in range(15)} and len(rows) == 15 * n and most < n * n / 4
    rows, most = most_rows(spark, lookup.fetch_clause(asked.select("query_id", "standard_no", "clause"), chunks))
    assert {r["chunk_id"] for r in rows} == {0} and len(rows) == n and most < n * n / 4


def test_long_lists_of_words_with_one_start(spark):
    n = 2500
    words = spark.range(n).select(F.concat(F.lit("GB "), (F.col("id") + 10000).cast("string")).alias("w"))
    texts = words.select(F.concat(F.lit("x"), "w").alias("t"))
    rows, most = most_rows(spark, lookup.contains_join(texts, "t", words, "w"))
    assert len(rows) == n and all(r["t"] == "x" + r["w"] for r in rows) and most < n * n / 4


def test_cascade_ranks_chunks_once_per_request(spark, monkeypatch):
    from docloom.operators import recall

    n = 600
    k = F.col("id")
    asked = spark.range(n).select(k.alias("query_id"), F.when(k % 3 == 0, "GB 100 第1.2条").when(k % 3 == 1, "GB 100").otherwise("第1.2条").alias("query_text"), F.when(k % 2 == 0, "A").alias("category"))
    chunks = spark.range(n).select(
        k.alias("chunk_id"), F.lit("GB 1000").alias("standard_no"), F.when(k >= n - 20, "1.2").otherwise("3.4").alias("clause"), F.lit("valid").alias("status"), F.lit("x").alias("content"),
        F.when(k >= 2, "child").otherwise("parent").alias("chunk_type"), F.lit(5).alias("position"), k.alias("reference_count"), F.when(k % 4 == 0, "A").otherwise("B").alias("category"))
    rows, most = most_rows(spark, recall.structured_recall(asked, chunks, 3, ["category"]))
    found = {(r["query_id"] % 6, r["tier"], r["rank"], r["chunk_id"]) for r in rows}
    by_clause = {0: [580, 584, 588], 3: [580, 581, 582]}
    expected = {(q, 1, i + 1, c) for q, cs in by_clause.items() for i, c in enumerate(cs)} | {(4, 3, 1, 0), (1, 3, 1, 0), (1, 3, 2, 1)}
    expected |= {(2, 5, i + 1, c) for i, c in enumerate([596, 592, 588])} | {(5, 5, i + 1, c) for i, c in enumerate([599, 598, 597])}
    assert found == expected and most < n * n / 8
    monkeypatch.setattr(recall, "MOST_SHIPPED", 0)
    assert sorted(recall.structured_recall(asked, chunks, 3, ["category"]).collect()) == sorted(rows)


def test_tables_of_one_text_are_searched_once(spark, monkeypatch):
    seen, whole = [], lookup.contains_join
    monkeypatch.setattr(lookup, "contains_join", lambda texts, *more, **named: (seen.append(texts.count()), whole(texts, *more, **named))[1])
    tables = spark.range(500).select(F.col("id").alias("table_id"), F.when(F.col("id") % 2 == 0, "red").alias("title"), F.lit("T1").alias("table_number"))
    asked = spark.createDataFrame([(1, ["red"]), (2, ["zz"]), (3, ["T1"])], "query_id long, w array<string>")
    found, missing = lookup.find_tables(asked, tables, F.col("w"))
    assert sorted((r["query_id"], r["table_id"]) for r in found.collect()) == [(1, i) for i in (0, 2, 4, 6, 8)] + [(3, i) for i in range(5)]
    assert [r["query_id"] for r in missing.collect()] == [2] and seen == [2]


def test_only_parts_that_can_be_a_word_leave_a_text(spark):
    n = lookup.MAX_INLINE_WORDS + 1
    words = spark.range(n).select((F.col("id") + 10000).cast("string").alias("w"))
    texts = spark.range(2000).select(F.concat_ws(" ", F.repeat(F.lit("abcdef "), 30), (F.col("id") + 10000).cast("string")).alias("t"))
    found = lookup.contains_join(texts, "t", words, "w")
    assert found.count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
