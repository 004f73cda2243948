"""Two-stage rerank, sufficiency rule, child expansion, image pull-along, citations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.functions import text as X
from docloom.functions.vectors import dot
from docloom.operators.skew import salted_join, top_k

Scorer = Callable[[Column, Column], Column]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(X.tokens(text), ""))


def overlap_score(q: Column, t: Column) -> Column:
    """Cheap pair score on word arrays: share of the question's words found, as a sigmoid."""
    return sigmoid(6 * F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)) - 3)


def overlap_and_density_score(q: Column, t: Column) -> Column:
    """Costlier pair score on word arrays: overlap plus how much of the text is about the question."""
    both = F.size(F.array_intersect(q, t))
    return sigmoid(4 * both / F.greatest(F.size(q), F.lit(1)) + 4 * both / F.greatest(F.size(F.array_union(q, t)), F.lit(1)) - 3)


def type_boost(content_type: Column, score: Column, boosts: Mapping[str, float] = P.TYPE_BOOST) -> Column:
    factor = F.coalesce(*[F.when(content_type == t, F.lit(b)) for t, b in boosts.items()], F.lit(1.0))
    return score * factor


def two_stage_rerank(
    hits: DataFrame,
    k: int = 5,
    coarse_k: int = 20,
    threshold: float = 0.2,
    coarse: Scorer = overlap_score,
    fine: Scorer = overlap_and_density_score,
    query: str = "query_words",
    text: str = "content_words",
) -> DataFrame:
    """Score all, keep the best ``coarse_k``, rescore, keep ``k``.

    Scorers take the two named columns: word arrays for the built-in ones, so a text is split
    once however many questions it is a candidate of; a model takes the raw texts instead.

    Questions with no more than ``k`` candidates keep their recall order. Candidates at or
    above the threshold come first; the rest only fill up. The type boost is applied once,
    on the final score.
    """
    # Candidates come from top-k recall, so a question has few of them and one scan of the
    # hits serves the count, both stages and the short lists.
    many = F.col("_n") > k
    q, t = F.col(query), F.col(text)
    rows = hits.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    first = rows.withColumn("_coarse", F.when(many, F.round(coarse(q, t), 6)))
    best = top_k(first, ["query_id"], [F.desc("_coarse"), F.asc("chunk_id")], max(k, coarse_k), "_r")
    second = best.where(~many | (F.col("_r") <= coarse_k)).withColumn(
        "_fine", F.when(many, F.round(fine(q, t), 6)).otherwise(F.col("score").cast("double"))
    )
    boosted = second.withColumn("_pass", ~many | (F.col("_fine") >= threshold)).withColumn(
        "final_score", F.round(type_boost(F.col("content_type"), F.col("_fine")), 6)
    )
    ranked = top_k(boosted, ["query_id"], [F.desc("_pass"), F.desc("final_score"), F.asc("chunk_id")], k)
    return ranked.drop("_n", "_coarse", "_r", "_fine", "_pass")


def recall_order(hits: DataFrame, k: int) -> DataFrame:
    """Fallback ordering by recall score with the type boost."""
    scored = hits.withColumn("final_score", F.round(type_boost(F.col("content_type"), F.col("score")), 6))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def sufficiency(queries: DataFrame, ranked: DataFrame, top1: float = 0.3, coverage: float = 0.2, min_count: int = 2, score: str = "final_score") -> DataFrame:
    """Rule check per question: rows (query_id, sufficient, reason)."""
    stats = ranked.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max_by(score, -F.col("rank")).alias("best"), F.count_if(F.col(score) >= coverage).alias("covered")
    )
    reason = (
        F.when(F.col("n").isNull(), "empty").when(F.col("best") < top1, "top1_low").when(F.col("covered") < min_count, "coverage_low").otherwise("")
    )
    return queries.select("query_id").join(stats, "query_id", "left").select("query_id", (reason == "").alias("sufficient"), reason.alias("reason"))


def expand_children(
    parents: DataFrame, children: DataFrame, query_vectors: DataFrame, threshold: float = 0.7, per_parent: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Similar children of each ranked parent and statistics per parent.

    ``parents`` (query_id, chunk_id), ``children`` (child_id, parent_id, vector),
    ``query_vectors`` (query_id, query_vector). A parent with very many children is spread
    over several tasks and cut to its best rows before the shuffle.
    """
    wanted = parents.select("query_id", F.col("chunk_id").alias("parent_id")).join(query_vectors, "query_id")
    paired = salted_join(children, wanted, ["parent_id"], spread_by=["child_id"])
    scored = paired.select("query_id", "parent_id", "child_id", F.round(dot("query_vector", "vector"), 6).alias("similarity"))
    kept = top_k(scored.where(F.col("similarity") >= threshold), ["query_id", "parent_id"], [F.desc("similarity"), F.asc("child_id")], per_parent)
    totals = scored.groupBy("query_id", "parent_id").agg(F.count("*").alias("total_children"))
    # Similarities are whole millionths, so their mean is exact and cut to millionths again.
    millionths = F.sum(F.round(F.col("similarity") * 1e6).cast("long"))
    filtered = kept.groupBy("query_id", "parent_id").agg(
        F.count("*").alias("kept_children"), (F.floor(millionths / F.count("*")) / 1e6).alias("avg_score")
    )
    stats = (
        parents.select("query_id", F.col("chunk_id").alias("parent_id"))
        .join(totals, ["query_id", "parent_id"], "left")
        .join(filtered, ["query_id", "parent_id"], "left")
        .select(
            "query_id", "parent_id", F.coalesce("total_children", F.lit(0)).alias("total_children"),
            F.coalesce("kept_children", F.lit(0)).alias("kept_children"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        )
    )
    return kept, stats


# ---------------------------------------------------------------- parents, children, images
def children_of(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Children of the given parent ids with their place."""
    kids = chunks.where(F.col("chunk_type") == "child").select(F.col("parent_chunk_id").alias("parent_id"), F.col("chunk_id").alias("child_id"), "position", "content")
    return salted_join(kids, parents.select("parent_id").distinct(), ["parent_id"], "left_semi", spread_by=["child_id"])


def figure_references(chunks: DataFrame, pattern: str = P.FIGURE_PATTERN, label: str = "图") -> DataFrame:
    """Rows (query_id, chunk_id, doc_id, figure, score) of figures a text or table chunk names."""
    numbers = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    return chunks.where(F.col("content_type").isin("text", "table")).select(
        "query_id", "chunk_id", "doc_id", "score", F.explode(F.transform(numbers, lambda n: F.concat(F.lit(label), n))).alias("figure")
    )


def inject_image_links(chunks: DataFrame, images: DataFrame, **pattern) -> DataFrame:
    """Chunks with the images they are or name: images is an array of (image_id, figure)."""
    own = chunks.select("query_id", "chunk_id").join(
        images.where(F.col("chunk_id").isNotNull()).select("chunk_id", "image_id", "figure"), "chunk_id"
    )
    named = figure_references(chunks, **pattern).join(images.select("doc_id", "figure", "image_id"), ["doc_id", "figure"])
    links = own.select("query_id", "chunk_id", "image_id", "figure").unionByName(named.select("query_id", "chunk_id", "image_id", "figure"))
    listed = links.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_set(F.struct("image_id", "figure"))).alias("images"))
    return chunks.join(listed, ["query_id", "chunk_id"], "left")


def pull_along_images(chunks: DataFrame, images: DataFrame, related: DataFrame, ratio: float = 0.8, **pattern) -> DataFrame:
    """Image chunks added to a hit list: rows (query_id, chunk_id, score, source).

    First those whose figure a hit names, then those related to a hit at ingest; a chunk
    that is already a hit is not added again. Score is the best parent score times ratio.
    """
    present = chunks.select("query_id", "chunk_id")
    by_figure = (
        figure_references(chunks, **pattern).groupBy("query_id", "doc_id", "figure").agg(F.max("score").alias("score"))
        .join(images.where(F.col("chunk_id").isNotNull()).select("doc_id", "figure", "chunk_id"), ["doc_id", "figure"])
        .groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        .join(present, ["query_id", "chunk_id"], "left_anti")
    )
    first = by_figure.select("query_id", "chunk_id", F.bround(F.col("score") * ratio, 4).alias("score"), F.lit("pull_along").alias("source"))
    texts = chunks.where(F.col("content_type").isin("text", "table")).select("query_id", "chunk_id", "score")
    linked = salted_join(texts, related.select("chunk_id", "related_id"), ["chunk_id"])
    by_relation = (
        linked.groupBy("query_id", F.col("related_id").alias("chunk_id")).agg(F.max("score").alias("score"))
        .join(present, ["query_id", "chunk_id"], "left_anti")
        .join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    )
    second = by_relation.select("query_id", "chunk_id", F.bround(F.col("score") * ratio, 4).alias("score"), F.lit("pull_along_semantic").alias("source"))
    return first.unionByName(second)


def images_near_text(texts: DataFrame, images: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Text chunk to image chunk links: page within one of the text's pages, or similar vectors.

    The page band becomes an equi-join on (doc_id, page); ``similar`` holds pairs at or
    above the cosine threshold, as ``nearest.similar_pairs`` gives them.
    """
    band = texts.select("doc_id", F.col("chunk_id").alias("text_id"), F.explode(F.sequence(F.col("page_start") - 1, F.col("page_end") + 1)).alias("page"))
    near = band.join(images.select("doc_id", "page", F.col("chunk_id").alias("image_id")), ["doc_id", "page"]).select("text_id", "image_id")
    return near.distinct() if similar is None else near.unionByName(similar.select("text_id", "image_id")).distinct()


# ---------------------------------------------------------------- citations
def citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Cited context chunk per marker: rows (answer_id, index, chunk_id, order_no)."""
    cited = answers.select("answer_id", F.posexplode(X.citation_indices("answer")).alias("order_no", "index"))
    return cited.join(context.select("answer_id", F.col("place").alias("index"), "chunk_id"), ["answer_id", "index"])


def citation_report(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Coverage per answer: cited, total, rate, markers out of range, text without citation."""
    totals = context.groupBy("answer_id").agg(F.count("*").alias("total_chunks"))
    base = answers.join(totals, "answer_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
    marks = X.citation_indices("answer")
    good = F.filter(marks, lambda i: (i >= 1) & (i <= F.col("total_chunks")))
    all_marks = F.transform(F.regexp_extract_all("answer", F.lit(P.CITATION_PATTERN), F.lit(1)), lambda x: x.cast("int"))
    bad = F.filter(all_marks, lambda i: ~((i >= 1) & (i <= F.col("total_chunks"))))
    uncovered = (F.length(F.trim("answer")) > 50) & (F.size(good) == 0)
    return base.select(
        "answer_id", F.size(good).alias("cited_count"), "total_chunks",
        F.round(F.coalesce(F.try_divide(F.size(good), F.col("total_chunks")), F.lit(0.0)), 6).alias("coverage_rate"),
        (F.col("total_chunks") - F.size(good)).alias("uncited_count"), F.size(bad).alias("invalid_count"),
        uncovered.alias("content_without_citation"),
        ((F.col("total_chunks") == F.size(good)) & (F.size(bad) == 0) & ~uncovered).alias("valid"),
    )


def context_prompt(chunks: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Numbered source blocks in rank order: rows (query_id, context)."""
    where = F.when(F.col("clause") != "", F.concat(F.lit("第"), F.col("clause"), F.lit("条"))).when(
        F.col("chapter") != "", F.concat(F.lit("第"), F.col("chapter"), F.lit("章"))
    )
    head = F.concat_ws(" ", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")), F.nullif("standard_no", F.lit("")), where)
    body = F.concat_ws("\n", head, F.coalesce("content", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), body.alias("b")))), lambda s: s["b"])
    return chunks.groupBy(*keys).agg(F.array_join(ordered, "\n\n").alias("context"))
