"""Connected components and greedy selection on pair tables, in bounded rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "node", max_rounds: int = 100) -> DataFrame:
    """Smallest node id of each component: rows (keys, node, component).

    Labels spread over the edges and are then replaced by the label of their label, so a
    long path closes in a logarithmic number of rounds. Minima are combined before each
    shuffle, so a hub costs one row per task. Each round ends in a checkpoint.
    """
    keys = list(keys)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(*keys, node).distinct().withColumn("component", F.col(node)))
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed(node, "a"), [*keys, "a"]).groupBy(*keys, F.col("b").alias(node)).agg(F.min("component").alias("_near"))
        spread = labels.join(seen, [*keys, node], "left").select(
            *keys, node, F.col("component").alias("_old"), F.least("component", F.coalesce("_near", "component")).alias("component")
        )
        jump = spread.select(*keys, F.col(node).alias("component"), F.col("component").alias("_next"))
        moved = cut_lineage(
            spread.join(jump, [*keys, "component"], "left").select(*keys, node, "_old", F.least("component", F.coalesce("_next", "component")).alias("component"))
        )
        labels = moved.drop("_old")
        if moved.where(F.col("_old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"components still moving after {max_rounds} rounds")


def greedy_suppressed(conflicts: DataFrame, keys: Sequence[str], max_rounds: int = 1000) -> DataFrame:
    """Ids dropped when items are taken in priority order and each taken one drops its losers.

    ``conflicts`` holds (keys, winner, loser) per conflicting pair. An item no open pair
    can drop is taken; its losers drop out together with the pairs they would have won.
    Every round settles a whole layer of the order, over all pages at once.
    """
    keys = list(keys)
    open_pairs = cut_lineage(conflicts.select(*keys, "winner", "loser").distinct())
    dropped = None
    for _ in range(max_rounds):
        if open_pairs.isEmpty():
            break
        threatened = open_pairs.select(*keys, F.col("loser").alias("winner")).distinct()
        safe = open_pairs.join(threatened, [*keys, "winner"], "left_anti")
        out = cut_lineage(safe.select(*keys, "loser").distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        remaining = open_pairs.join(out, [*keys, "loser"], "left_anti")
        remaining = remaining.join(out.withColumnRenamed("loser", "winner"), [*keys, "winner"], "left_anti")
        open_pairs = cut_lineage(remaining)
    else:
        raise RuntimeError(f"conflicts still open after {max_rounds} rounds")
    return conflicts.select(*keys, "loser").limit(0) if dropped is None else dropped
