"""Cross-reference edges, bounded closure, versions, orphans, back-fill."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import has_reference_words, referenced_standards
from docloom.operators.skew import salted_join, top_k
from docloom.session import cut_lineage


def reference_edges(chunks: DataFrame, text: str = "content", key: str = "chunk_id") -> DataFrame:
    """Edges (source, target standard) of chunks that refer to other standards."""
    return chunks.where(has_reference_words(F.col(text))).select(
        F.col(key).alias("source"), F.explode(referenced_standards(text)).alias("target")
    )


def expand_references(edges: DataFrame, chunks: DataFrame, k: int = 10, order: str = "position") -> DataFrame:
    """One hop: best chunks of every referenced standard, at most ``k`` per question and standard."""
    best = top_k(chunks, ["standard_no"], [F.asc_nulls_first(order), F.asc("chunk_id")], k)
    return salted_join(edges, best.withColumnRenamed("standard_no", "target"), ["target"])


def closure(edges: DataFrame, depth: int = 3, checkpoint: bool = True) -> DataFrame:
    """Shortest hop count up to ``depth`` between nodes: rows (source, target, hops).

    A frontier of newly reached pairs is joined to the edges and the pairs already seen are
    taken out. Popular nodes gather many frontier rows, so that side is salted. Each round
    is cut off from its history, so plans stay small and lost executors cost one round.
    """
    edges = edges.select("source", "target").distinct()
    edges = cut_lineage(edges) if checkpoint else edges
    seen = edges.where(F.col("source") != F.col("target")).withColumn("hops", F.lit(1))
    frontier = seen
    step = edges.select(F.col("source").alias("_via"), F.col("target").alias("_next"))
    for hops in range(2, depth + 1):
        moved = salted_join(frontier.select("source", F.col("target").alias("_via")), step, ["_via"])
        fresh = moved.select("source", F.col("_next").alias("target")).where(F.col("source") != F.col("target")).distinct()
        frontier = fresh.join(seen.select("source", "target"), ["source", "target"], "left_anti").withColumn("hops", F.lit(hops))
        frontier = cut_lineage(frontier) if checkpoint and hops < depth else frontier
        seen = seen.unionByName(frontier)
    return seen


def latest_versions(documents: DataFrame, base: str, order: list[str], valid: Column) -> DataFrame:
    """Latest valid version per base number, as one aggregation."""
    return documents.where(valid).groupBy(base).agg(F.max_by("doc_id", F.struct(*order)).alias("latest_id"))


def resolve_chain(links: DataFrame, rounds: int = 40, checkpoint: bool = True) -> DataFrame:
    """End of every replaced-by chain: rows (doc_id, final_id, steps).

    Pointers are doubled each round, so a chain of n links takes log2(n) joins. A pointer that
    comes back to a document it has passed runs in a circle: such documents have no end and get a
    null final_id and null steps. Chains that still move after ``rounds`` rounds are an error.
    """
    start = links.select("doc_id", F.coalesce("replaced_by", "doc_id").alias("final_id"), F.col("replaced_by").isNotNull().cast("long").alias("steps"))
    state = start
    total = None
    for _ in range(rounds):
        ahead = state.select(F.col("doc_id").alias("_id"), F.col("final_id").alias("_to"), F.col("steps").alias("_more")).where("_more > 0")
        moved = state.join(ahead, F.col("final_id") == F.col("_id"), "left").select(
            "doc_id", F.coalesce("_to", "final_id").alias("final_id"),
            (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_to").isNotNull().alias("_moved"),
        )
        moved = cut_lineage(moved) if checkpoint else moved
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state
        # No chain without a circle has more links than there are documents.
        total = links.count() if total is None else total
        if moved.where(F.col("_moved") & (F.col("steps") <= total)).isEmpty():
            lost = F.col("_moved")
            return moved.select("doc_id", F.when(~lost, F.col("final_id")).alias("final_id"), F.when(~lost, F.col("steps")).alias("steps"))
    raise RuntimeError(f"chains still moving after {rounds} rounds")


# ---------------------------------------------------------------- store consistency
def orphans(stores: Mapping[str, DataFrame], master: DataFrame, key: str) -> DataFrame:
    """Ids present in a store but not in the master table: rows (store, key)."""
    found = None
    for name, df in stores.items():
        ids = df.select(key).distinct().join(master.select(key), key, "left_anti").select(F.lit(name).alias("store"), key)
        found = ids if found is None else found.unionByName(ids)
    return found


def missing_entries(master: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Master rows without an entry in the store."""
    return master.join(store.select(key).distinct(), key, "left_anti")


def delete_documents(stores: Mapping[str, DataFrame], tombstones: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Stores without the deleted documents, and how many rows each store lost per document."""
    gone = tombstones.select(key).distinct()
    kept = {n: salted_join(df, gone, [key], "left_anti") for n, df in stores.items()}
    lost = None
    for name, df in stores.items():
        rows = salted_join(df, gone, [key], "left_semi").select(key, F.lit(name).alias("store"))
        lost = rows if lost is None else lost.unionByName(rows)
    return kept, lost.groupBy(key).pivot("store", list(stores)).count().na.fill(0)


def backfill(df: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """Empty values of a column taken from a key-to-value table."""
    value = known.select(key, F.col(column).alias("_known"))
    filled = salted_join(df, value, [key], "left")
    return filled.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("_known"))).drop("_known")


def keep_known_anchors(entries: DataFrame, body: DataFrame) -> DataFrame:
    """Contents entries keep their anchor only when a body block of the document has it."""
    known = body.select("doc_id", F.trim("anchor").alias("_a")).where(F.col("_a") != "").distinct()
    wanted = entries.withColumn("_a", F.trim("anchor"))
    matched = wanted.join(known.withColumn("_hit", F.lit(True)), ["doc_id", "_a"], "left")
    has_any = known.select("doc_id").distinct().withColumn("_any", F.lit(True))
    # A document without any body anchor is left as it is.
    return matched.join(has_any, "doc_id", "left").withColumn(
        "anchor", F.when(F.col("_any").isNull(), F.col("anchor")).when(F.col("_hit"), F.col("_a"))
    ).drop("_a", "_hit", "_any")
