"""Recall over rewrites of a question, and filters that give way when it finds too little.

A path is a function from questions to hits: it takes (query_id, query_text, …) and gives (query_id, chunk_id,
score), respecting the filter columns of the questions. All questions, and all their rewrites, go
through a path in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.operators import recall
from docloom.session import cut_lineage

Path = Callable[[DataFrame], DataFrame]
#: Rewrites of one question, itself included; lists of the paths asked once come after theirs.
MOST_VARIANTS = 64


def recall_rewrites(
    variants: DataFrame, paths: Mapping[str, Path], each: Sequence[str] = ("vector", "keyword"), once: Sequence[str] = ("structured", "visual"),
    limits: Mapping[str, int] | None = None, limit: int = P.FUSED_LIMIT,
) -> DataFrame:
    """Fused hits (query_id, chunk_id, score, sources, rank) of questions asked in several wordings.

    ``variants`` has query_id, variant (0 is the question itself, then its rewrites, fewer than
    ``MOST_VARIANTS``), query_text, hypothetical (an answer made up for the question, may be null) and
    filter columns. The paths of ``each`` are asked with every wording and give a list per
    wording; the vector path takes the hypothetical answer for the question itself. Those of ``once`` see the
    question alone. Paths that are not there are left out. Empty rewrites are not asked.
    """
    asked = variants.where((F.col("variant") == 0) | (F.trim(F.coalesce("query_text", F.lit(""))) != ""))
    lists = None
    for no, name in enumerate(n for n in (*each, *once) if n in paths):
        if name in each:
            text = F.coalesce(F.when(F.col("variant") == 0, F.col("hypothetical")), "query_text") if name == "vector" else F.col("query_text")
            mine = asked.withColumn("query_text", text).withColumn("query_id", F.col("query_id") * MOST_VARIANTS + F.col("variant")).drop("variant", "hypothetical")
            hits = paths[name](mine).select(
                F.floor(F.col("query_id") / MOST_VARIANTS).cast("long").alias("query_id"), "chunk_id", "score", (F.pmod("query_id", F.lit(MOST_VARIANTS)) * len(each) + no).cast("int").alias("list_no")
            )
        else:
            hits = paths[name](asked.where("variant = 0").drop("variant", "hypothetical")).select("query_id", "chunk_id", "score", F.lit(MOST_VARIANTS * len(each) + no).alias("list_no"))
        hits = hits.withColumn("source", F.lit(name))
        lists = hits if lists is None else lists.unionByName(hits)
    return recall.reciprocal_rank_fusion(recall.rank_lists(lists, limits), limit)


def relaxed_recall(queries: DataFrame, path: Path, order: Sequence[str] = tuple(P.RELAXATION_ORDER), minimum: int = P.RELAXATION_MIN_HITS) -> tuple[DataFrame, DataFrame]:
    """Hits of each question under its first set of filters that finds enough, and what became of its filters.

    A question with fewer than ``minimum`` hits loses its next filter that is set, in ``order``, and is
    asked again; with none left it keeps what the last try found. Only the questions that lack hits
    are asked again, at most once per filter, and each level's hits are written once. Returns hits
    with level, and (query_id, level, hits, relaxed, filters still set) for every question.
    """
    order = list(order)
    levels = recall.filter_levels(queries, order)
    last = levels.groupBy("query_id").agg(F.max("level").alias("_last"))
    open_, hits, facts = None, None, None
    for level in range(len(order) + 1):
        asked = levels.where(F.col("level") == level)
        if open_ is not None:
            asked = asked.join(open_, "query_id", "left_semi")
        found = cut_lineage(path(asked.drop("level")).withColumn("level", F.lit(level)))
        counts = found.groupBy("query_id").agg(F.count("*").alias("hits"))
        state = asked.join(counts, "query_id", "left").join(last, "query_id").withColumn("hits", F.coalesce("hits", F.lit(0)))
        state = cut_lineage(state.select("query_id", "level", "hits", *order, ((F.col("hits") >= minimum) | (F.col("level") == F.col("_last"))).alias("_done")))
        done = state.where("_done")
        kept, facts_now = found.join(done.select("query_id"), "query_id", "left_semi"), done.select("query_id", "level", "hits", (F.col("level") > 0).alias("relaxed"), *order)
        hits, facts = (kept, facts_now) if hits is None else (hits.unionByName(kept), facts.unionByName(facts_now))
        open_ = state.where("NOT _done").select("query_id")
        if open_.isEmpty():
            break
    return hits, facts


def leaders(chunks: DataFrame, filters: Sequence[str], k: int) -> Path:
    """Path of the first chunks (by chunk_id) that hold all filters set; answered once per distinct set of filters."""
    filters = list(filters)

    def run(asked: DataFrame) -> DataFrame:
        named = asked.select("query_id", *[F.col(f).alias(f"_f_{f}") for f in filters])
        top = recall._leaders_by_filter(chunks, named.select(*[f"_f_{f}" for f in filters]).distinct(), filters, [F.asc("chunk_id")], k)
        wanted = named.select("query_id", recall.filter_key([f"_f_{f}" for f in filters]).alias("_set"))
        return wanted.join(top.select("_set", "chunk_id"), "_set").select("query_id", "chunk_id", F.lit(1.0).alias("score"))

    return run
