"""Text that belongs to a caption: on its line, stacked above a table, or at the head of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import boxes as B
from docloom.functions import presets as P
from docloom.functions import text as X
from docloom.operators.ordered import position_bucket, scan
from docloom.session import cut_lineage

PAGE = ["doc_id", "page_idx"]
BOX = ("x0", "y0", "x1", "y1")
FRAGMENTS = ["text", "footnote"]


def _near(box: B.Box, table: B.Box) -> Column:
    """Whether a box lies beside or within the width of a table, give or take a little."""
    slack = F.greatest(F.lit(12.0), 0.03 * F.greatest(table.width, F.lit(1)))
    return (box.x1 >= table.x0 - slack) & (box.x0 <= table.x1 + slack)


def _reach(height: Column) -> Column:
    """Largest gap between parts of one caption."""
    return F.greatest(F.lit(12.0), 1.5 * F.greatest(height, F.lit(1)))


def on_caption_line(blocks: DataFrame, mains: Sequence[str], kind: str = "type", bucket: int = 256) -> DataFrame:
    """``blocks`` with _line: a fragment between a caption and a figure, on the caption's line.

    Page furniture in between is passed over.
    """
    solid = F.when(~F.col(kind).isin(P.FURNITURE_TYPES), F.struct(F.col(kind).alias("kind"), *BOX))
    place = position_bucket("block_idx", bucket)
    seen = scan(blocks, PAGE, ["block_idx"], place, fills_before={"_before": solid})
    seen = scan(seen, PAGE, ["block_idx"], place, fills_before={"_after": solid}, descending=True)
    own, caption, figure = B.box(), B.struct_box("_before"), B.struct_box("_after")
    low, high = (F.greatest(b.height, F.lit(1)) for b in (own, caption))
    level = ((F.least(own.y1, caption.y1) - F.greatest(own.y0, caption.y0)) / F.least(low, high) >= 0.6) | (F.abs(own.center_y - caption.center_y) <= F.greatest(low, high) * 0.5)
    gap = figure.y0 - F.greatest(own.y1, caption.y1)
    found = F.col(kind).isin(FRAGMENTS) & (F.col("_before.kind") == "caption") & F.col("_after.kind").isin(list(mains)) & level & gap.between(F.lit(0), _reach(F.greatest(low, high)))
    return seen.withColumn("_line", F.coalesce(found, F.lit(False))).drop("_before", "_after")


def stacked_fragments(blocks: DataFrame, tables: Sequence[str], kind: str = "type") -> DataFrame:
    """(page, block_idx) of one-line fragments between a table and the lowest caption stacked above it.

    Upwards from a table, captions, texts and footnotes beside it make a stack while each gap is small
    for the tallest of them so far. Only what stands below the stack's lowest caption is its
    fragment, so the notes of a table further up are left alone.
    """
    table = blocks.where(F.col(kind).isin(list(tables))).select(*PAGE, F.col("block_idx").alias("table_idx"), F.struct(*BOX).alias("_t"))
    part = blocks.where(F.col(kind).isin("caption", *FRAGMENTS)).select(*PAGE, "block_idx", F.col(kind).alias("kind"), "lines", *BOX)
    t = B.struct_box("_t")
    above = part.join(table, PAGE).where((F.col("y1") <= t.y0) & _near(B.box(), t))
    upwards = Window.partitionBy(*PAGE, "table_idx").orderBy(F.desc("y0"), F.desc("block_idx"))
    so_far = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.coalesce(F.lag("y0").over(upwards), t.y0) - F.col("y1")
    tight = above.withColumn("_ok", gap.between(F.lit(0), _reach(F.max(B.box().height).over(so_far))))
    stack = tight.withColumn("_in", F.min("_ok").over(so_far)).withColumn("_n", F.row_number().over(upwards)).where("_in")
    lowest = F.min(F.when(F.col("kind") == "caption", F.col("_n"))).over(Window.partitionBy(*PAGE, "table_idx"))
    below = stack.withColumn("_c", lowest).where((F.col("_n") < F.col("_c")) & F.col("kind").isin(FRAGMENTS) & (F.coalesce("lines", F.lit(1)) <= 1))
    return below.select(*PAGE, "block_idx").distinct()


def leading_continuations(blocks: DataFrame, tables: Sequence[str], kind: str = "type", bucket: int = 256) -> DataFrame:
    """(page, block_idx) of the lines at the head of a page that say a table goes on and stand right above it.

    All of them have to stand near the table and close together, else none counts.
    """
    solid = blocks.where(~F.col(kind).isin(P.FURNITURE_TYPES))
    says = F.col(kind).isin(FRAGMENTS) & (F.coalesce("lines", F.lit(1)) <= 1) & F.coalesce(X.is_continuation_caption("text"), F.lit(False))
    marked = scan(solid.withColumn("_says", says), PAGE, ["block_idx"], position_bucket("block_idx", bucket), sums={"_other": (~F.col("_says")).cast("long")}).where("_says OR _other = 1")
    first = marked.where("NOT _says").groupBy(*PAGE).agg(F.min_by(F.struct(F.col(kind).alias("kind"), *BOX), "block_idx").alias("_t"))
    head = marked.where("_says AND _other = 0").join(first, PAGE).where(F.col("_t.kind").isin(list(tables)))
    upwards = Window.partitionBy(*PAGE).orderBy(F.desc("block_idx"))
    tallest = F.max(F.greatest(B.box().height, F.lit(1))).over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gap = F.coalesce(F.lag("y0").over(upwards), F.col("_t.y0")) - F.col("y1")
    close = gap.between(-F.greatest(F.lit(2.0), 0.3 * F.greatest(B.box().height, F.lit(1))), _reach(tallest)) & _near(B.box(), B.struct_box("_t"))
    judged = head.withColumn("_ok", close)
    return judged.withColumn("_all", F.min("_ok").over(Window.partitionBy(*PAGE))).where("_all").select(*PAGE, "block_idx")


def caption_fallbacks(blocks: DataFrame, mains: Sequence[str], tables: Sequence[str] = ("table",), bucket: int = 256) -> DataFrame:
    """``blocks`` with new_type: fragments that belong to a caption become captions.

    First those on a caption's line, then those stacked above a table, then those at a page's head.
    ``blocks`` has doc_id, page_idx, block_idx, type, a box, text and lines (null counts as one).
    Decisions for several tables of a page are made side by side. The rows are read once and
    then kept in the checkpoint folder, as three steps look at them.
    """
    place = [*PAGE, "block_idx"]
    line = cut_lineage(on_caption_line(blocks, mains, bucket=bucket).withColumn("_kind", F.when(F.col("_line"), "caption").otherwise(F.col("type"))).drop("_line"))
    stacked = stacked_fragments(line, tables, "_kind").withColumn("_stacked", F.lit(True))
    known = line.join(stacked, place, "left").withColumn("_kind", F.when(F.col("_stacked"), "caption").otherwise(F.col("_kind"))).drop("_stacked")
    head = leading_continuations(known, tables, "_kind", bucket).withColumn("_head", F.lit(True))
    return known.join(head, place, "left").withColumn("new_type", F.when(F.col("_head"), "caption").otherwise(F.col("_kind"))).drop("_kind", "_head")
