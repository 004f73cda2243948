"""The question lanes as composed jobs over many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import ranking, recall
from docloom.session import cut_lineage


def candidates(hits: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with text and word columns, short texts, contents pages and repeats removed; only texts of hits are cut into words."""
    asked = queries.select("query_id", ranking.distinct_words(F.col("query_text")).alias("query_words"))
    found = hits.select("query_id", "chunk_id", "score").join(texts, "chunk_id").withColumn("content_words", ranking.distinct_words(F.col("content")))
    full = found.join(asked, "query_id")
    return recall.clean_candidates(full)


def fast_lane(queries: DataFrame, hits: DataFrame, retry_hits: DataFrame, texts: DataFrame, first_k: int = 8, retry_k: int = 10) -> DataFrame:
    """Recall to ranked context: clean, rerank, judge, and search once more where it falls short.

    ``hits`` are fused recall hits, ``retry_hits`` the hits of the refined questions, ``texts``
    (chunk_id, content, content_type). Only insufficient questions take part in the second
    round, and they keep their first ranking when it brings nothing new. Hits and candidates of
    both rounds are written once, as several steps read them.
    """
    hits = cut_lineage(hits.select("query_id", "chunk_id", "score"))
    first = cut_lineage(candidates(hits, texts, queries))
    ranked = cut_lineage(ranking.two_stage_rerank(first, first_k).drop("content", "content_words", "query_words"))
    verdict = ranking.sufficiency(queries, ranked)
    lacking = cut_lineage(verdict.where(~F.col("sufficient")).select("query_id"))
    again = retry_hits.select("query_id", "chunk_id", "score").join(lacking, "query_id", "left_semi")
    before = hits.select("query_id", "chunk_id", "score").join(lacking, "query_id", "left_semi")
    merged = cut_lineage(candidates(recall.merge_hits(before, again), texts, queries))
    retried = ranking.two_stage_rerank(merged, retry_k).drop("content", "content_words", "query_words")
    old = ranked.join(lacking, "query_id", "left_semi")
    second = recall.keep_unless_new(old, retried, merged, first.join(lacking, "query_id", "left_semi"), retry_k)
    done = ranked.join(lacking, "query_id", "left_anti").withColumn("rounds", F.lit(1))
    result = done.unionByName(second.withColumn("rounds", F.lit(2)))
    return result.select("query_id", "chunk_id", "final_score", "rank", "rounds")
