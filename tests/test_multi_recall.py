"""Recall over rewrites and filters that give way, with paths that are plain tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.operators import multi_recall  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["red fox", "blue fox", "red hen", "blue hen", "old red barn", "answer text"]
    return spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "chunk_id long, content string, kind string")


def holding(corpus, score=1.0):
    """Path of the chunks that hold the question's text."""
    return lambda asked: asked.join(corpus, F.col("content").contains(F.col("query_text"))).select("query_id", "chunk_id", F.lit(score).alias("score"))


def test_wordings_and_the_hypothetical_answer(spark, corpus):
    variants = spark.createDataFrame(
        [(1, 0, "red", "answer"), (1, 1, "hen", None), (1, 2, " ", None), (2, 0, "barn", None), (3, 0, "nothing", None)], "query_id long, variant int, query_text string, hypothetical string"
    )
    exact = lambda asked: asked.where("query_text = 'red'").select("query_id", F.lit(3).cast("long").alias("chunk_id"), F.lit(1.0).alias("score"))
    got = multi_recall.recall_rewrites(variants, {"vector": holding(corpus), "keyword": holding(corpus), "structured": exact})
    found = {(r.query_id, r.chunk_id): (r.sources, r["rank"]) for r in got.collect()}
    one = {c: s for (q, c), (s, _) in found.items() if q == 1}
    # vector asks for the made-up answer, keyword for the question, both for the rewrite; the blank rewrite is not asked
    assert one == {5: "vector", 0: "keyword", 2: "keyword+vector", 4: "keyword", 3: "vector+keyword+structured"}
    assert (found[1, 2][1], found[1, 3][1]) == (1, 2) and {c for q, c in found if q == 2} == {4} and not any(q == 3 for q, _ in found)


def test_lists_are_cut_and_fused_to_the_limit(spark):
    many = spark.range(100).select(F.col("id").alias("chunk_id"))
    path = lambda asked: asked.crossJoin(many).select("query_id", "chunk_id", (-F.col("chunk_id")).cast("double").alias("score"))
    one = spark.createDataFrame([(7, 0, "x", None)], "query_id long, variant int, query_text string, hypothetical string")
    got = [r.chunk_id for r in multi_recall.recall_rewrites(one, {"keyword": path}, limits={"keyword": 9, "structured": 2}, limit=5).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_filters_give_way_one_by_one(spark):
    chunks = spark.createDataFrame([(i, v, c, None) for i, (v, c) in enumerate([("10", "a"), ("10", "a"), ("10", "a"), ("35", "b"), ("35", "a"), ("20", "b")])], "chunk_id long, voltage_level string, category string, doc_type string")
    asked = spark.createDataFrame([(1, "10", "a", None), (2, "35", "b", None), (3, "35", "zzz", "manual"), (4, None, None, None), (5, "99", None, None)], "query_id long, voltage_level string, category string, doc_type string")
    order = ["voltage_level", "category", "doc_type"]
    hits, facts = multi_recall.relaxed_recall(asked, multi_recall.leaders(chunks, order, 4), order)
    state = {r.query_id: (r.level, r.hits, r.relaxed, r.voltage_level, r.category) for r in facts.collect()}
    # 2: two of category b are not enough, so all filters go; 3: dropping everything finds the first four; 4 has none to drop
    assert state == {1: (0, 3, False, "10", "a"), 2: (2, 4, True, None, None), 3: (3, 4, True, None, None), 4: (0, 4, False, None, None), 5: (1, 4, True, None, None)}
    found: dict = {}
    for r in hits.collect():
        found.setdefault(r.query_id, set()).add((r.chunk_id, r.level))
    assert found[1] == {(0, 0), (1, 0), (2, 0)} and found[2] == {(i, 2) for i in range(4)} and found[5] == {(i, 1) for i in range(4)}


def test_nothing_found_keeps_the_last_try(spark):
    none = spark.createDataFrame([], "chunk_id long, category string")
    hits, facts = multi_recall.relaxed_recall(spark.createDataFrame([(1, "a")], "query_id long, category string"), multi_recall.leaders(none, ["category"], 4), ["category"])
    assert hits.count() == 0 and [(r.level, r.hits) for r in facts.collect()] == [(1, 0)]
