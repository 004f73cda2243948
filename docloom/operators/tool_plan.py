"""The multi-step lane: each question follows a plan of tools, many questions at once.

A plan is a table; deciding what to ask next is a model's part and comes in as its rows. Steps
are unrolled, at most ``STEPS`` of them: a step sends the questions of each tool through that tool's
join, and what it finds can be parameters of the next.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import lookup, recall, search
from docloom.operators.skew import salted_join, top_k
from docloom.session import cut_lineage

STEPS = 3
PER_STEP = 15
STANDARDS_PASSED_ON = 5
COMBINED = 20
#: Columns of a plan besides query_id, step and tool; all may be null.
PARAMETERS = {
    "query": "string", "standards": "array<string>", "use_found": "boolean", "standard_id": "string", "clause": "string", "keyword": "string", "category": "string", "table_title": "string",
}
WORD = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Found:
    """Hits (query_id, chunk_id, score, rank) of a tool, and standards (query_id, standards) it discovered."""

    hits: DataFrame | None = None
    standards: DataFrame | None = None


Tool = Callable[[DataFrame], Found]


def words_of(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda w: w != ""))


def in_standards(asked: DataFrame, chunks: DataFrame, k: int = PER_STEP) -> DataFrame:
    """Best chunks of the named standards by the share of the question's words they hold."""
    named = asked.select("query_id", words_of("query").alias("_q"), F.explode(F.array_distinct("standards")).alias("standard_no"))
    # Chunks are rated once per different wording and standard; a question's best are among those of its standards.
    on = ["_q", "standard_no"]
    near = salted_join(chunks.select("chunk_id", "standard_no", words_of("content").alias("_w")), named.select(*on).distinct(), ["standard_no"], spread_by=["chunk_id"])
    share = F.size(F.array_intersect("_q", "_w")) / F.greatest(F.size("_q"), F.lit(1))
    rated = near.select(*on, "chunk_id", F.round(share, 6).alias("score")).where("score > 0").groupBy(*on, "chunk_id").agg(F.max("score").alias("score"))
    best = top_k(rated, on, [F.desc("score"), F.asc("chunk_id")], k, "_r").drop("_r")
    scored = salted_join(named, best, on, spread_by=["query_id"]).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def retrieve_standard(chunks: DataFrame, k: int = PER_STEP) -> Tool:
    """Text recall, within standards where a step names some, else over everything by BM25."""

    def run(asked: DataFrame) -> Found:
        some = F.size(F.coalesce("standards", F.array())) > 0
        within = in_standards(asked.where(some), chunks, k)
        free = asked.where(~some).select("query_id", F.coalesce("query", F.lit("")).alias("query_text"))
        anywhere = search.keyword_topk(free, search.tokenize(chunks, "chunk_id", "content"), "chunk_id", k)
        return Found(within.unionByName(anywhere.select(*within.columns)))

    return run


def retrieve_clause(chunks: DataFrame) -> Tool:
    """The one chunk of an exact standard and clause, score 1."""

    def run(asked: DataFrame) -> Found:
        wanted = asked.where("standard_id IS NOT NULL AND clause IS NOT NULL").select("query_id", F.col("standard_id").alias("standard_no"), "clause")
        hits = lookup.fetch_clause(wanted, chunks)
        return Found(hits.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank")))

    return run


def list_related(documents: DataFrame, fields: list[str]) -> Tool:
    """Standards of completed documents that hold a keyword; no hits, only names for the next step."""

    def run(asked: DataFrame) -> Found:
        listed = lookup.related_documents(asked.where("keyword IS NOT NULL").select("query_id", "keyword", "category"), documents, fields)
        first = listed.where(F.col("rank") <= STANDARDS_PASSED_ON)
        names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "standard_no"))), lambda s: s["standard_no"])
        return Found(standards=first.groupBy("query_id").agg(F.array_distinct(names).alias("standards")))

    return run


def retrieve_table(tables: DataFrame, text_recall: Tool) -> Tool:
    """Tables by title words or number, optionally of a standard; without any, text recall for the title.

    ``tables`` has table_id, chunk_id, title, table_number and standard_no; a table without a chunk
    stands for itself.
    """

    def run(asked: DataFrame) -> Found:
        wanted = asked.select("query_id", F.coalesce("table_title", F.lit("")).alias("table_title"), "standard_id")
        found, missing = lookup.find_tables(wanted, tables)
        hits = found.select("query_id", F.coalesce("chunk_id", "table_id").alias("chunk_id"), F.lit(1.0).alias("score"), "rank")
        again = missing.select("query_id", F.concat("table_title", F.lit(" 表格")).alias("query"), F.when(F.col("standard_id").isNotNull(), F.array("standard_id")).alias("standards"))
        return Found(hits.unionByName(text_recall(again).hits))

    return run


def standard_tools(chunks: DataFrame, documents: DataFrame, tables: DataFrame, fields: list[str]) -> dict[str, Tool]:
    """The four tools under the names that plans use."""
    text = retrieve_standard(chunks)
    return {"retrieve_standard": text, "retrieve_clause": retrieve_clause(chunks), "list_related_standards": list_related(documents, fields), "retrieve_table": retrieve_table(tables, text)}


def run_plan(plan: DataFrame, tools: Mapping[str, Tool], steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, step, tool, chunk_id, score, rank) and a trace (query_id, step, tool, results).

    ``plan`` has query_id, step from 1, tool and the columns of ``PARAMETERS``. A question stops at
    the first step that is missing or names no known tool (``sufficient``, for example); later rows
    of it are not run. ``use_found`` stands for the standards that the latest listing before found;
    named ``standards`` go first. A step's hits are written once, as the next step and the trace read them.
    """
    alive, found, hits, trace = plan.select("query_id").distinct(), None, None, None
    for n in range(1, steps + 1):
        now = plan.where((F.col("step") == n) & F.col("tool").isin(sorted(tools))).join(alive, "query_id", "left_semi")
        if found is not None:
            now = now.join(found.withColumnRenamed("standards", "_found"), "query_id", "left")
            now = now.withColumn("standards", F.coalesce("standards", F.when(F.col("use_found"), F.col("_found")))).drop("_found")
        now = cut_lineage(now)
        alive = now.select("query_id").distinct()
        used = {r["tool"] for r in now.select("tool").distinct().collect()}  # no more than there are tools
        made, learned = hits.limit(0) if hits is not None else None, found
        for name, tool in tools.items():
            if name not in used:
                continue
            result = tool(now.where(F.col("tool") == name))
            if result.hits is not None:
                rows = result.hits.select("query_id", F.lit(n).alias("step"), F.lit(name).alias("tool"), "chunk_id", "score", "rank")
                made = rows if made is None else made.unionByName(rows)
            if result.standards is not None:
                new = result.standards
                learned = new if learned is None else new.unionByName(learned.join(new, "query_id", "left_anti"))
        found = None if learned is None else cut_lineage(learned)
        if made is None:  # nothing but listings, or nothing at all, so far
            made = plan.sparkSession.createDataFrame([], "query_id long, step int, tool string, chunk_id long, score double, rank int")
        made = cut_lineage(made)
        counts = made.groupBy("query_id", "step", "tool").agg(F.count("*").alias("results"))
        taken = now.select("query_id", F.lit(n).alias("step"), "tool").distinct().join(counts, ["query_id", "step", "tool"], "left").fillna({"results": 0})
        hits = made if hits is None else hits.unionByName(made)
        trace = taken if trace is None else trace.unionByName(taken)
    return hits, trace


def combined(hits: DataFrame, limit: int = COMBINED) -> DataFrame:
    """Chunks of all steps, first occurrence counts, best scores first."""
    return recall.combine_steps(hits.drop("tool"), limit)
