"""Page layout: spatial joins, suppression, captions, lines, paragraphs, reading order.

Blocks and boxes come as rows. Pairs are found through grid cells, never by pairing all
boxes of a page; order-dependent steps use the bucketed scans of ``ordered``, so neither a
crowded page nor a huge document ends in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import boxes as B
from docloom.functions import presets as P
from docloom.functions import text as X
from docloom.operators.components import connected_components, greedy_suppressed
from docloom.operators.grouped import map_groups
from docloom.operators.ordered import position_bucket, scan
from docloom.operators.pages import texts_of_chars
from docloom.operators.skew import best_row
from docloom.session import cut_lineage

COORDS = ("x0", "y0", "x1", "y1")
PAGE = ("doc_id", "page_idx")


# ---------------------------------------------------------------- spatial joins
def spatial_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Pairs of boxes that touch, columns prefixed ``l_`` and ``r_``.

    Both sides are written to the grid cells they cover. A pair is reported by the one cell
    holding the upper left corner of its intersection, so nothing needs deduplication.
    """
    def gridded(df: DataFrame, prefix: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])
        span = lambda a, b: F.sequence(F.floor(F.col(prefix + a) / cell).cast("long"), F.floor(F.col(prefix + b) / cell).cast("long"))
        return named.withColumn("_gx", F.explode(span("x0", "x1"))).withColumn("_gy", F.explode(span("y0", "y1")))

    pairs = gridded(left, "l_").join(gridded(right, "r_"), [*keys, "_gx", "_gy"])
    l, r = B.box("l_"), B.box("r_")
    x0, y0 = F.greatest(l.x0, r.x0), F.greatest(l.y0, r.y0)
    touching = (x0 <= F.least(l.x1, r.x1)) & (y0 <= F.least(l.y1, r.y1))
    home = (F.floor(x0 / cell) == F.col("_gx")) & (F.floor(y0 / cell) == F.col("_gy"))
    return pairs.where(touching & home).drop("_gx", "_gy")


def overlapping_pairs(boxes: DataFrame, keys: Sequence[str], box_id: str, cell: float = 64.0) -> DataFrame:
    """Touching pairs of one box table, each once with l_id < r_id."""
    return spatial_join(boxes, boxes, keys, cell).where(F.col(f"l_{box_id}") < F.col(f"r_{box_id}"))


def drop_contained(boxes: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """Boxes not inside another box; of identical boxes none stays.

    Copies are folded to one row first, so a pile of equal boxes makes no pairs.
    """
    folded = boxes.groupBy(*keys, *COORDS).agg(F.count("*").alias("_n"))
    single = folded.where("_n = 1").drop("_n")
    distinct = folded.drop("_n")
    inside = spatial_join(distinct, distinct, keys, cell).where(
        B.contains(B.box("l_"), B.box("r_")) & reduce(lambda a, b: a | b, [F.col(f"l_{c}") != F.col(f"r_{c}") for c in COORDS])
    )
    gone = inside.select(*keys, *[F.col(f"l_{c}").alias(c) for c in COORDS]).distinct()
    kept = single.join(gone, [*keys, *COORDS], "left_anti")
    return boxes.join(kept, [*keys, *COORDS], "left_semi")


def suppress_boxes(boxes: DataFrame, keys: Sequence[str], box_id: str, score: str = "score", threshold: float = 0.9, cell: float = 64.0) -> DataFrame:
    """Greedy suppression by IoU: higher score first, then lower id."""
    columns = boxes.select(*keys, box_id, score, *COORDS)
    pairs = overlapping_pairs(columns, keys, box_id, cell).where(B.iou(B.box("l_"), B.box("r_")) > threshold)
    left_wins = F.col(f"l_{score}") >= F.col(f"r_{score}")
    conflicts = pairs.select(
        *keys, F.when(left_wins, F.col(f"l_{box_id}")).otherwise(F.col(f"r_{box_id}")).alias("winner"),
        F.when(left_wins, F.col(f"r_{box_id}")).otherwise(F.col(f"l_{box_id}")).alias("loser"),
    )
    lost = greedy_suppressed(conflicts, keys).select(*keys, F.col("loser").alias(box_id))
    return boxes.join(lost, [*keys, box_id], "left_anti")


VISUAL_LABELS = frozenset({"image", "table", "seal", "chart"})


def filter_boxes(boxes: DataFrame, keys: Sequence[str], box_id: str, drop_inline: bool = True, min_side: float = 6.0, cell: float = 64.0) -> DataFrame:
    """Drop tiny boxes and, of boxes overlapping by 0.7 of the smaller, the smaller one.

    A picture, table, seal or chart may overlap another kind of visual box; inline formulas
    go at an overlap of 0.5. What a pair would drop is known from the pair alone; a pair counts
    only while both its boxes are there, in the order of the boxes. So the pairs of a connected
    group are folded in that order, in the JVM.
    """
    usable = boxes.where(F.col("label") != "reference")
    inline = F.col("label") == "inline_formula"
    keep_small = F.lit(False) if drop_inline else inline
    # A tiny box can still push out an earlier one, but not a later one.
    usable = usable.withColumn("_small", B.is_small(B.box(), min_side) & ~keep_small)
    pairs = overlapping_pairs(usable.select(*keys, box_id, "label", "_small", *COORDS), keys, box_id, cell).where("NOT l__small")
    a, b = F.col(f"l_{box_id}"), F.col(f"r_{box_id}")
    share = B.overlap_min_area(B.box("l_"), B.box("r_"))
    formula_a, formula_b = F.col("l_label") == "inline_formula", F.col("r_label") == "inline_formula"
    visual = lambda c: F.col(c).isin(sorted(VISUAL_LABELS))
    table = (F.col("l_label") == "table") | (F.col("r_label") == "table")
    spared = (F.col("l_label") != F.col("r_label")) & (visual("l_label") | visual("r_label")) & (~table | (visual("l_label") & visual("r_label")))
    formulas = F.filter(F.array(F.when(formula_a, a), F.when(formula_b, b)), lambda x: x.isNotNull())
    smaller = F.array(F.when(B.box("l_").area >= B.box("r_").area, b).otherwise(a))
    drops = F.when((formula_a | formula_b) & (share > 0.5), formulas if drop_inline else None).when(~formula_a & ~formula_b & (share > 0.7) & ~spared, smaller)
    telling = pairs.select(*keys, a.alias("a"), b.alias("b"), drops.alias("drops")).where(F.col("drops").isNotNull())
    groups = connected_components(telling.select(*keys, F.explode(F.array("a", "b")).alias("node")), telling, keys)
    work = telling.join(groups.withColumnRenamed("node", "a"), [*keys, "a"])
    gone = F.aggregate(
        F.array_sort(F.collect_list(F.struct("a", "b", "drops"))), F.filter(F.array(F.first("a")), lambda x: x.isNull()),
        lambda gone, p: F.when(F.array_contains(gone, p["a"]) | F.array_contains(gone, p["b"]), gone).otherwise(F.concat(gone, p["drops"])),
    )
    lost = work.groupBy(*keys, "component").agg(gone.alias("gone")).select(*keys, F.explode("gone").alias(box_id)).distinct()
    return usable.where("NOT _small").drop("_small").join(lost, [*keys, box_id], "left_anti")


def merge_nested_boxes(boxes: DataFrame, keys: Sequence[str], box_id: str, threshold: float = 0.7, cell: float = 64.0, max_rounds: int = 50) -> DataFrame:
    """Unite boxes overlapping by the threshold of the smaller one until none do.

    Of two boxes the larger (then the better score, then the lower id) keeps its id and takes the
    union, on whole numbers, and the best score. A box that lies in one that lies in a third
    lies in the union of those two just as much, so in each round the smaller box of every pair points
    to a larger one, pointers are followed to the largest, and each box there takes in all that
    reach it. A grown box may meet new ones, so it repeats; a chain closes in one round.
    """
    state = cut_lineage(boxes.select(*keys, box_id, "score", *[F.col(c).cast("double").alias(c) for c in COORDS]))
    for _ in range(max_rounds):
        pairs = overlapping_pairs(state, keys, box_id, cell).where(B.overlap_min_area(B.box("l_"), B.box("r_")) >= threshold)
        rank = lambda p: F.struct(B.box(p).area.alias("area"), F.col(f"{p}score").alias("score"), (-F.col(f"{p}{box_id}")).alias("order"), F.col(f"{p}{box_id}").alias("id"))
        low, high = F.least(rank("l_"), rank("r_")), F.greatest(rank("l_"), rank("r_"))
        into = cut_lineage(pairs.select(*keys, low["id"].alias(box_id), high.alias("into")).groupBy(*keys, box_id).agg(F.max("into").alias("into")).select(*keys, box_id, F.col("into.id").alias("into")))
        if into.isEmpty():
            return state
        while True:  # each round halves the way to the largest box
            ahead = into.select(*keys, F.col(box_id).alias("into"), F.col("into").alias("_next"))
            into = cut_lineage(into.join(ahead, [*keys, "into"], "left").select(*keys, box_id, F.coalesce("_next", "into").alias("into"), F.col("_next").isNotNull().alias("_moved")))
            if into.where("_moved").isEmpty():
                break
        placed = state.join(into.drop("_moved"), [*keys, box_id], "left").withColumn("_root", F.coalesce("into", box_id))
        one = F.count("*") == 1
        side = lambda c, pick, whole: F.when(one, F.first(c)).otherwise(whole(pick(c)).cast("double")).alias(c)
        state = cut_lineage(placed.groupBy(*keys, F.col("_root").alias(box_id)).agg(
            F.when(one, F.first("score")).otherwise(F.round(F.max("score"), 4)).alias("score"),
            side("x0", F.min, F.floor), side("y0", F.min, F.floor), side("x1", F.max, F.ceil), side("y1", F.max, F.ceil),
        ))
    raise RuntimeError(f"boxes still merging after {max_rounds} rounds")


def relabel_covered(boxes: DataFrame, keys: Sequence[str], box_id: str, parents: Column, threshold: float = 0.7, inside: str = "inline_formula", outside: str = "display_formula", member: Column | None = None, cell: float = 64.0) -> DataFrame:
    """Label of member boxes by whether some parent box covers them."""
    member = F.col("label").isin(inside, outside) if member is None else member
    columns = boxes.select(*keys, box_id, *COORDS, member.alias("_m"), parents.alias("_p"))
    pairs = spatial_join(columns.where("_m").drop("_m", "_p"), columns.where("_p").drop("_m", "_p"), keys, cell)
    held = pairs.where((F.col(f"l_{box_id}") != F.col(f"r_{box_id}")) & (B.overlap_own_area(B.box("l_"), B.box("r_")) >= threshold))
    hit = held.select(*keys, F.col(f"l_{box_id}").alias(box_id)).distinct().withColumn("_in", F.lit(True))
    label = F.when(member, F.when(F.col("_in"), inside).otherwise(outside)).otherwise(F.col("label"))
    return boxes.join(hit, [*keys, box_id], "left").withColumn("label", label).drop("_in")


def split_titles(titles: DataFrame, document_titles: DataFrame, keys: Sequence[str], box_id: str, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Titles overlapping a document-title box become document titles, the rest paragraph titles."""
    pairs = spatial_join(titles.select(*keys, box_id, *COORDS), document_titles.select(*keys, *COORDS), keys, cell)
    hit = pairs.where(B.overlap_min_area(B.box("l_"), B.box("r_")) >= threshold).select(*keys, F.col(f"l_{box_id}").alias(box_id)).distinct()
    return titles.join(hit.withColumn("_d", F.lit(True)), [*keys, box_id], "left").withColumn(
        "type", F.when(F.col("_d"), "doc_title").otherwise("paragraph_title")
    ).drop("_d")


def containers_by_center(items: DataFrame, containers: DataFrame, keys: Sequence[str], item_id: str, container_id: str, cell: float = 64.0) -> DataFrame:
    """Container holding an item's centre, the one with the largest overlap: rows (keys, item, container)."""
    pairs = spatial_join(items.select(*keys, item_id, *COORDS), containers.select(*keys, container_id, *COORDS), keys, cell)
    l, r = B.box("l_"), B.box("r_")
    holds = (l.center_x >= r.x0) & (l.center_x <= r.x1) & (l.center_y >= r.y0) & (l.center_y <= r.y1)
    scored = pairs.where(holds).select(
        *keys, F.col(f"l_{item_id}").alias(item_id), F.col(f"r_{container_id}").alias(container_id), B.overlap_area(l, r).alias("overlap")
    )
    return best_row(scored, [*keys, item_id], [F.desc("overlap"), F.asc(container_id)])


def absorb_members(members: DataFrame, composites: DataFrame, keys: Sequence[str], box_id: str, threshold: float = 0.9, cell: float = 64.0) -> DataFrame:
    """Composite picture of each member: best overlap, then smallest, then first.

    Rows (keys, member, parent, relative box in the parent).
    """
    pairs = spatial_join(members.select(*keys, box_id, *COORDS), composites.select(*keys, box_id, *COORDS), keys, cell)
    l, r = B.box("l_"), B.box("r_")
    scored = pairs.where(F.col(f"l_{box_id}") != F.col(f"r_{box_id}")).withColumn("_o", B.overlap_own_area(l, r)).where(F.col("_o") >= threshold)
    best = best_row(scored, [*keys, f"l_{box_id}"], [F.desc("_o"), r.area.asc(), F.asc(f"r_{box_id}")])
    return best.select(*keys, F.col(f"l_{box_id}").alias("member"), F.col(f"r_{box_id}").alias("parent"), B.relative_box(l, r).alias("relative"))


def chars_to_text(chars: DataFrame, keys: Sequence[str], body_ratio: float = 0.9, tolerance: float = 0.15, gap: float = 0.25) -> DataFrame:
    """``texts_of_chars`` for characters that come as rows; a span is one printed line, so it is collected."""
    spans = chars.groupBy(*keys).agg(F.collect_list(F.struct("char_idx", "char", *COORDS)).alias("chars"))
    return texts_of_chars(spans, keys, body_ratio, tolerance, gap)


# ---------------------------------------------------------------- captions
def nearest_main(blocks: DataFrame, mains: Sequence[str], children: Sequence[str], rule: str = "center", bucket: int = 256) -> DataFrame:
    """Main block (figure or table) of each caption or footnote on a page.

    Distance is counted in blocks that are no captions themselves, so only the nearest main
    block before and after can win. A tie goes to the nearer edge when it is nearer by more
    than 2, then by the rule (``later``, ``earlier`` or ``center`` distance).
    """
    child = F.col("type").isin(list(children))
    rank = scan(blocks, PAGE, ["block_idx"], position_bucket("block_idx", bucket), sums={"_c": child.cast("long")})
    # Position with captions before it taken out; a caption does not count itself.
    rank = rank.withColumn("_e", F.col("block_idx") - F.col("_c") + child.cast("long"))
    main = F.when(F.col("type").isin(list(mains)), F.struct(F.col("block_idx").alias("idx"), F.col("_e").alias("e"), *COORDS))
    both = scan(rank, PAGE, ["block_idx"], position_bucket("block_idx", bucket), fills_before={"_prev": main})
    both = scan(both, PAGE, ["block_idx"], position_bucket("block_idx", bucket), fills_before={"_next": main}, descending=True)
    kids = both.where(child)
    own, prev, nxt = B.box(), B.struct_box("_prev"), B.struct_box("_next")
    to_prev = F.col("_e") - F.col("_prev.e")
    to_next = F.col("_next.e") - F.col("_e") + 1
    edge_prev, edge_next = B.edge_distance(own, prev), B.edge_distance(own, nxt)
    last = {"later": F.lit(False), "earlier": F.lit(True), "center": B.center_distance(own, prev) <= B.center_distance(own, nxt)}[rule]
    use_prev = (
        F.when(F.col("_next").isNull(), True).when(F.col("_prev").isNull(), False).when(to_prev != to_next, to_prev < to_next)
        .when(F.abs(edge_prev - edge_next) > 2, edge_prev < edge_next).otherwise(last)
    )
    return kids.select(*PAGE, "block_idx", "type", F.when(use_prev, F.col("_prev.idx")).otherwise(F.col("_next.idx")).alias("main_idx"))


def type_captions(blocks: DataFrame, mains: Sequence[str] = ("table", "image", "chart"), bucket: int = 256) -> DataFrame:
    """Captions take the kind of the main block they adjoin, the one before first.

    A text right after a main block that opens like its caption becomes one; captions
    adjoining nothing become text. Captions in between do not break adjacency.
    """
    opens = {"table": "^(表|table)", "image": "^(图|fig)", "chart": "^(图|fig|chart)"}
    before = scan(blocks, PAGE, ["block_idx"], position_bucket("block_idx", bucket), previous={"_before": F.col("type")})
    text = F.lower(F.trim("text"))
    opening = reduce(lambda a, b: a | b, [(F.col("_before") == m) & text.rlike(opens[m]) for m in mains if m in opens])
    kind = F.when((F.col("type") == "text") & F.coalesce(opening, F.lit(False)), "caption").otherwise(F.col("type"))
    typed = before.withColumn("_kind", kind)
    solid = F.when(F.col("_kind") != "caption", F.col("_kind"))
    near = scan(typed, PAGE, ["block_idx"], position_bucket("block_idx", bucket), fills_before={"_p": solid})
    near = scan(near, PAGE, ["block_idx"], position_bucket("block_idx", bucket), fills_before={"_n": solid}, descending=True)
    is_main = lambda c: F.col(c).isin(list(mains))
    final = (
        F.when(F.col("_kind") != "caption", F.col("_kind")).when(is_main("_p"), F.concat(F.col("_p"), F.lit("_caption")))
        .when(is_main("_n"), F.concat(F.col("_n"), F.lit("_caption"))).otherwise("text")
    )
    return near.withColumn("new_type", final).drop("_before", "_kind", "_p", "_n")


# ---------------------------------------------------------------- formulas, headers
def attach_formula_numbers(blocks: DataFrame, bucket: int = 256) -> DataFrame:
    """Formula numbers merged into the formula before them, else the one after.

    The one after is taken only when no number follows it. Numbers without a formula, or
    with an empty one, become text. Rows keep (new_type, new_text, merged).
    """
    view = F.struct("type", "text")
    near = scan(blocks, PAGE, ["block_idx"], position_bucket("block_idx", bucket), previous={"_p": view})
    near = scan(near, PAGE, ["block_idx"], position_bucket("block_idx", bucket), previous={"_n": view}, descending=True)
    second = F.struct(F.col("_n"), F.col("_p"))
    near = scan(near, PAGE, ["block_idx"], position_bucket("block_idx", bucket), previous={"_nn": F.col("_n.type"), "_after": second}, descending=True)
    near = scan(near, PAGE, ["block_idx"], position_bucket("block_idx", bucket), previous={"_pp": F.col("_p.type")})
    number, formula = F.col("type") == "formula_number", F.col("type") == "equation"
    filled = lambda t: F.coalesce(X.strip_display_formula(t) != "", F.lit(False))
    has_prev = F.coalesce(F.col("_p.type") == "equation", F.lit(False))
    has_next = F.coalesce(F.col("_n.type") == "equation", F.lit(False)) & F.coalesce(F.col("_nn") != "formula_number", F.lit(True))
    merged = number & ((has_prev & filled(F.col("_p.text"))) | (~has_prev & has_next & filled(F.col("_n.text"))))
    # A formula takes the number after it; the number before it only when that one did not
    # belong to an earlier formula and no other number follows.
    number_after = F.coalesce(F.col("_n.type") == "formula_number", F.lit(False))
    number_before = F.coalesce(F.col("_p.type") == "formula_number", F.lit(False)) & F.coalesce(F.col("_pp") != "equation", F.lit(True)) & ~number_after
    tag = F.when(number_after, F.col("_n.text")).when(number_before, F.col("_p.text"))
    new_text = F.when(formula & tag.isNotNull(), F.coalesce(X.tagged_formula("text", tag), F.col("text"))).otherwise(F.col("text"))
    new_type = F.when(number & ~merged, "text").otherwise(F.col("type"))
    return near.select(*blocks.columns, new_type.alias("new_type"), new_text.alias("new_text"), merged.alias("merged"))


# --- fixed values: labels no boundary rule changes, labels of page regions -----------------
EXEMPT_LABELS = ["number", "header_image", "footer_image", "aside_text"]
REGION_LABELS = ["header", "header_image", "footer", "footer_image", "number", "aside_text", "footnote"]


def relabel_page_edges(boxes: DataFrame, keys: Sequence[str], width: float, height: float, order: str = "box_id") -> DataFrame:
    """Header and footer labels corrected from the page's own anchors.

    First by page half; then boxes above the lowest header become headers, boxes under a
    footnote footnotes, boxes below the highest footer footers, and boxes beyond a page
    number in the outer 30 % headers or footers. Anchors are one aggregation per page; only
    the footnote rule joins boxes, and it needs just the enclosing footnotes.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    upper = mid < height * 0.5
    label = F.col("label")
    half = (
        F.when(upper & (label == "footer"), "header").when(upper & (label == "footer_image"), "header_image")
        .when(~upper & (label == "header"), "footer").when(~upper & (label == "header_image"), "footer_image").otherwise(label)
    )
    b = boxes.withColumn("_half", half)
    head, foot = F.col("_half").isin("header", "header_image"), F.col("_half").isin("footer", "footer_image")
    number_top = (F.col("_half") == "number") & (mid <= height * 0.3)
    number_low = (F.col("_half") == "number") & (mid >= height * 0.7)
    anchors = b.groupBy(*keys).agg(
        F.max(F.when(head, F.col("y1"))).alias("_hb"),
        F.min(F.when(foot, F.struct("y0", F.col(order), "x0", "x1"))).alias("_fa"),
        F.max(F.when(number_top, F.struct("y1", F.col(order), "y0"))).alias("_nt"),
        F.min(F.when(number_low, F.struct("y0", F.col(order), "y1"))).alias("_nb"),
    )
    b = b.join(anchors, list(keys)).withColumn("_anchor", head | foot)
    free = ~F.col("_half").isin(EXEMPT_LABELS)
    above = free & ~head & (F.col("y1") <= F.col("_hb"))
    b = b.withColumn("_l1", F.when(F.coalesce(above, F.lit(False)), "header").otherwise(F.col("_half")))
    notes = b.where(F.col("_l1") == "footnote").select(*keys, F.col("x0").alias("x0"), "y0", "x1", F.lit(float(height) * 4).alias("y1"))
    candidates = b.where(~F.col("_l1").isin(REGION_LABELS)).select(*keys, order, *COORDS)
    pairs = spatial_join(candidates, notes, keys, 128.0).where(
        (F.col("l_y0") >= F.col("r_y0")) & (B.x_projection_overlap(B.box("l_"), B.box("r_")) >= 0.7)
    )
    under = pairs.select(*keys, F.col(f"l_{order}").alias(order)).distinct().withColumn("_under", F.lit(True))
    b = b.join(under, [*keys, order], "left").withColumn("_l2", F.when(F.col("_under"), "footnote").otherwise(F.col("_l1")))
    wide = (F.col("_fa.x1") - F.col("_fa.x0")) / width >= 0.7
    overlap = F.greatest(F.least(F.col("x1"), F.col("_fa.x1")) - F.greatest(F.col("x0"), F.col("_fa.x0")), F.lit(0.0))
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("_fa.x1") - F.col("_fa.x0"))
    below = ~F.col("_l2").isin(EXEMPT_LABELS) & ~F.col("_l2").isin("footer", "footer_image") & (F.col("y0") >= F.col("_fa.y0")) & (wide | (overlap / narrow >= 0.3))
    b = b.withColumn("_l3", F.when(F.coalesce(below, F.lit(False)), "footer").otherwise(F.col("_l2")))
    loose = ~F.col("_anchor") & ~F.col("_l3").isin(EXEMPT_LABELS)
    top = F.coalesce(loose & (F.col("y1") <= F.col("_nt.y0")), F.lit(False))
    low = F.coalesce(loose & (F.col("y0") >= F.col("_nb.y1")), F.lit(False))
    return b.withColumn("new_label", F.when(low, "footer").when(top, "header").otherwise(F.col("_l3"))).select(*boxes.columns, "new_label")


# ---------------------------------------------------------------- lines and intervals
def _bucketed(df: DataFrame, keys: Sequence[str], column: str, width: float) -> Column:
    return F.floor(F.col(column) / width).cast("long")


def build_vertical_lines(spans: DataFrame, keys: Sequence[str], span_id: str, threshold: float = 0.6, bucket: float = 256.0) -> DataFrame:
    """Vertical text: columns from right to left, a span joins by shared width."""
    turned = spans.withColumn("_m", -F.col("x1"))
    seen = scan(turned, keys, ["_m", span_id], _bucketed(turned, keys, "_m", bucket), previous={"_p": F.struct("x0", "x1")})
    shared = F.greatest(F.least("x1", F.col("_p.x1")) - F.greatest("x0", F.col("_p.x0")), F.lit(0))
    low = F.least(F.col("x1") - F.col("x0"), F.col("_p.x1") - F.col("_p.x0"))
    together = F.col("_p").isNotNull() & (low > 0) & (shared / low > threshold)
    opened = seen.withColumn("_o", (~F.coalesce(together, F.lit(False))).cast("long"))
    return scan(opened, keys, ["_m", span_id], _bucketed(opened, keys, "_m", bucket), sums={"column_no": F.col("_o")}).drop("_p", "_o", "_m")


def vertical_blocks(spans: DataFrame, keys: Sequence[str], ratio: float = 2.0, share: float = 0.8) -> DataFrame:
    """Whether a block's spans are mostly tall: rows (keys, vertical)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = spans.where((w > 0) & (h > 0))
    return sized.groupBy(*keys).agg((F.avg((h / w > ratio).cast("double")) > share).alias("vertical"))


def merge_intervals(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket: int = 1024) -> DataFrame:
    """Union of the intervals of each key; touching ones join."""
    folded = intervals.groupBy(*keys, start).agg(F.max(end).alias(end))
    reach = scan(folded, keys, [start], position_bucket(start, bucket), maxes_before={"_reach": F.col(end)})
    opened = reach.withColumn("_o", (F.col("_reach").isNull() | (F.col("_reach") < F.col(start))).cast("long"))
    islands = scan(opened, keys, [start], position_bucket(start, bucket), sums={"_island": F.col("_o")})
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract_intervals(originals: DataFrame, masks: DataFrame, keys: Sequence[str], cell: int = 64, bucket: int = 1024) -> DataFrame:
    """Parts of each original left outside the merged masks of its key, with gaps of one.

    Masks and originals meet through cells of the number line; what remains lies between
    consecutive masks of one original.
    """
    merged = merge_intervals(masks, keys)
    base = originals.select(*keys, F.col("start").alias("o_start"), F.col("end").alias("o_end")).distinct()
    cells = lambda df, a, b: df.withColumn("_c", F.explode(F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))))
    hits = cells(base, "o_start", "o_end").join(cells(merged, "start", "end"), [*keys, "_c"])
    hits = hits.where((F.col("start") <= F.col("o_end")) & (F.col("end") >= F.col("o_start"))).drop("_c").distinct()
    group = [*keys, "o_start", "o_end"]
    stepped = scan(hits, group, ["start"], position_bucket("start", bucket), previous={"_before": F.col("end")})
    gaps = stepped.select(*group, F.greatest(F.coalesce(F.col("_before") + 1, F.col("o_start")), F.col("o_start")).alias("start"), (F.col("start") - 1).alias("end"))
    last = hits.groupBy(*group).agg((F.max("end") + 1).alias("start"))
    tails = base.join(last, group, "left").select(*group, F.greatest(F.coalesce("start", "o_start"), F.col("o_start")).alias("start"), F.col("o_end").alias("end"))
    return gaps.unionByName(tails).where(F.col("start") <= F.col("end"))


def merge_line_spans(spans: DataFrame, keys: Sequence[str], wide: float = 4.0, bucket: int = 1024) -> DataFrame:
    """Overlapping spans of a line united to their common box, on lines wider than four heights."""
    line = spans.groupBy(*keys).agg(
        ((F.max("x1") - F.min("x0")) > (F.max("y1") - F.min("y0")) * wide).alias("_wide")
    )
    rows = spans.join(line, list(keys))
    narrow = rows.where(~F.col("_wide")).select(*keys, *COORDS)
    folded = rows.where("_wide").groupBy(*keys, "x0").agg(F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    reach = scan(folded, keys, ["x0"], position_bucket("x0", bucket), maxes_before={"_reach": F.col("x1")})
    opened = reach.withColumn("_o", (F.col("_reach").isNull() | (F.col("_reach") < F.col("x0"))).cast("long"))
    islands = scan(opened, keys, ["x0"], position_bucket("x0", bucket), sums={"_i": F.col("_o")})
    united = islands.groupBy(*keys, "_i").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return united.select(*keys, *COORDS).unionByName(narrow)


# ---------------------------------------------------------------- paragraphs
# --- fixed values: marks that end a paragraph or a list item; types around paragraphs -------
LIST_STOPS = [".", "。", ";", "；"]


def merge_runs(blocks: DataFrame, kind: str, order: str = "line_no", bucket: int = 1024) -> DataFrame:
    """Run number of consecutive blocks of one type (lists, index entries, references)."""
    seen = scan(blocks, ["doc_id"], [order], position_bucket(order, bucket), previous={"_p": F.col("type")})
    starts = ((F.col("type") == kind) & (F.coalesce(F.col("_p"), F.lit("")) != kind)).cast("long")
    runs = scan(seen.withColumn("_o", starts), ["doc_id"], [order], position_bucket(order, bucket), sums={"run": F.col("_o")})
    return runs.where(F.col("type") == kind).drop("_p", "_o")


def classify_blocks(lines: DataFrame, keys: Sequence[str], page_width: float, line_id: str = "line_no") -> DataFrame:
    """list, index or text per block, from the geometry and ends of its lines.

    Counters are plain sums, combined before the shuffle. Lines carry x0..y1 and text.
    """
    frame = lines.groupBy(*keys).agg(
        F.min("x0").alias("_bx0"), F.max("x1").alias("_bx1"), F.min("y0").alias("_by0"), F.max("y1").alias("_by1"),
        F.min_by(F.struct(*COORDS), line_id).alias("_first"), F.max_by(F.struct(*COORDS), line_id).alias("_last"),
    )
    l = lines.join(frame, list(keys)).withColumn("_h", F.col("_first.y1") - F.col("_first.y0")).withColumn("_w", F.col("_bx1") - F.col("_bx0"))
    t = F.trim("text")
    cjk = t.rlike("[一-鿿]")
    area = F.when(cjk | (F.col("_w") / page_width >= 0.5), 0.26).otherwise(0.36) * F.col("_w")
    left, right, h = F.col("x0") - F.col("_bx0"), F.col("_bx1") - F.col("x1"), F.col("_h")
    n = lambda cond: F.sum(cond.cast("long"))
    right_close = F.abs(right) < h
    end, start = F.substring(t, -1, 1), F.substring(t, 1, 1)
    stats = l.groupBy(*keys).agg(
        F.count("*").alias("n"), n((left > 0.7 * h) & (right > 0.7 * h)).alias("inner"),
        n(F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("_bx0") + F.col("_bx1")) / 2) < h / 2).alias("centered"),
        n(F.abs(left) < h / 2).alias("left_close"), n(left > h).alias("left_open"), n(right_close).alias("right_close"),
        n(~right_close & (right > area)).alias("right_open"), n(end.isin(LIST_STOPS)).alias("ends"),
        n(start.rlike(r"^\p{Nd}$")).alias("num_start"), n(end.rlike(r"^\p{Nd}$")).alias("num_end"),
        F.first(
            (F.col("_first.x0") - F.col("_bx0") > h / 2) & (F.abs(F.col("_last.x0") - F.col("_bx0")) < h / 2) & (F.col("_bx1") - F.col("_last.x1") > h)
        ).alias("several"),
        F.first((F.col("_by1") - F.col("_by0")) / F.col("_w")).alias("shape"),
    )
    share = lambda c: F.col(c) / F.col("n")
    numbered = (share("num_start") >= 0.8) | (share("num_end") >= 0.8)
    kind = (
        F.when(F.col("n") < 2, "text")
        .when(((share("left_close") >= 0.8) | (share("right_close") >= 0.8)) & numbered, "index")
        .when((F.col("inner") >= 2) & (F.col("centered") == F.col("n")) & (share("inner") >= 0.5) & (F.col("shape") > 0.4), "list")
        .when(
            (F.col("left_close") >= 2) & ((F.col("right_open") >= 2) | (share("ends") >= 0.8) | (F.col("left_open") >= 2)) & ~F.col("several"), "list"
        )
        .otherwise("text")
    )
    return stats.select(*keys, "n", "left_close", "right_close", "right_open", "ends", kind.alias("kind"))


def title_groups(blocks: DataFrame, order: str = "line_no", bucket: int = 1024) -> DataFrame:
    """Group number of paragraph titles between document titles."""
    numbered = scan(blocks, ["doc_id"], [order], position_bucket(order, bucket), sums={"title_group": (F.col("type") == "doc_title").cast("long")})
    return numbered.where(F.col("type") == "paragraph_title")


def offset_title_level(level: Column) -> Column:
    """Level 1 becomes 2 under a document title."""
    return F.when(level == 1, 2).otherwise(level)


def title_line_height(titles: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean whole line height of each title, its own height when it has no lines."""
    h = F.col("y1") - F.col("y0")
    means = lines.where(h > 0).groupBy(*keys).agg(F.avg(h.cast("int")).alias("_m"))
    return titles.join(means, list(keys), "left").withColumn("line_avg_height", F.coalesce("_m", F.greatest(F.lit(0), h.cast("int")).cast("double"))).drop("_m")


def page_density(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding region of each page and the share of it that blocks fill."""
    g = blocks.groupBy(*keys).agg(
        F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"), F.sum(B.box().area).alias("_a")
    )
    region = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    density = F.when(region <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_a") / region))
    return g.withColumn("density", F.round(density, 6)).drop("_a")


# ---------------------------------------------------------------- reading order
def row_order(boxes: DataFrame, keys: Sequence[str], box_id: str, tolerance: float = 10.0, bucket: float = 512.0) -> DataFrame:
    """Top to bottom, left to right: boxes whose tops follow within the tolerance form a row."""
    order = ["y0", "x0", box_id]
    seen = scan(boxes, keys, order, _bucketed(boxes, keys, "y0", bucket), previous={"_p": F.col("y0")})
    opened = seen.withColumn("_o", (F.col("_p").isNull() | (F.col("y0") - F.col("_p") >= tolerance)).cast("long"))
    rows = scan(opened, keys, order, _bucketed(opened, keys, "y0", bucket), sums={"row_no": F.col("_o")})
    w = Window.partitionBy(*keys, "row_no").orderBy("x0", "y0", box_id)
    return rows.withColumn("place", F.row_number().over(w)).drop("_p", "_o")


def _widest_gap(lo: np.ndarray, hi: np.ndarray) -> tuple[float, float]:
    """Largest empty stretch of a projection and its middle."""
    if len(lo) < 2:
        return 0.0, 0.0
    order = np.lexsort((hi, lo))
    reach = np.maximum.accumulate(hi[order])[:-1]
    gaps = lo[order][1:] - reach
    best = int(np.argmax(gaps))
    return (float(gaps[best]), float((lo[order][1:][best] + reach[best]) / 2)) if gaps[best] > 0 else (0.0, 0.0)


def _cut(b: np.ndarray, ids: np.ndarray, min_gap: float, narrow: float) -> list:
    """Reading order of boxes: split at the widest gap, else by top and left."""
    stack, out = [ids], []
    while stack:
        part = stack.pop()
        p = b[part]
        y_gap, y_at = _widest_gap(p[:, 1], p[:, 3])
        x_gap, x_at = _widest_gap(p[:, 0], p[:, 2])
        if x_gap < min_gap and len(part) >= 3:
            wide = (p[:, 2] - p[:, 0]) >= (p[:, 2].max() - p[:, 0].min()) * narrow
            if 2 <= wide.sum() < len(part):
                gap, at = _widest_gap(p[wide, 0], p[wide, 2])
                if gap > x_gap and gap >= min_gap:
                    x_gap, x_at = gap, at
        axis, at = (1, y_at) if y_gap >= min_gap and (x_gap < min_gap or y_gap > x_gap) else (0, x_at)
        before = (p[:, axis] + p[:, axis + 2]) / 2 < at
        if max(x_gap, y_gap) < min_gap or before.all() or not before.any():
            out.extend(part[np.lexsort((part, p[:, 0], p[:, 1]))])
        else:
            stack.extend([part[~before], part[before]])
    return out


def xycut_order(boxes: DataFrame, keys: Sequence[str], box_id: str, beta: float = 2.0, min_gap: float = 5.0, narrow: float = 0.1, overlap: float = 0.1) -> DataFrame:
    """Reading order by recursive cuts at white space: rows (keys, box_id, place).

    Elements of at least ``beta`` times the page's median width that overlap two others are set
    apart first and merged back by their top. One printed page is one group.
    """
    schema = T.StructType([*[boxes.schema[k] for k in keys], boxes.schema[box_id], T.StructField("place", T.LongType())])

    def order_page(g: dict) -> dict:
        b = np.column_stack([g[c] for c in COORDS]).astype(float)
        ids = np.arange(len(b))
        if len(b) == 1:
            return {box_id: g[box_id], "place": np.array([1])}
        width = b[:, 2] - b[:, 0]
        apart = np.zeros(len(b), dtype=bool)
        if len(b) >= 3:
            middle = np.sort(width)[[(len(b) - 1) // 2, len(b) // 2]].mean()
            for i in np.flatnonzero(width >= beta * middle):
                shared = np.minimum(b[i, 2], b[:, 2]) - np.maximum(b[i, 0], b[:, 0])
                ratio = np.where(shared > 0, shared / np.minimum(width[i], width), 0.0)
                ratio[i] = 0.0
                apart[i] = (ratio >= overlap).sum() >= 2
        main = _cut(b, ids[~apart], min_gap, narrow) if (~apart).any() else []
        across = sorted(ids[apart], key=lambda i: (b[i, 1], b[i, 0], i))
        merged = []
        for i in main:
            while across and b[across[0], 1] <= b[i, 1]:
                merged.append(across.pop(0))
            merged.append(i)
        merged.extend(across)
        return {box_id: g[box_id][merged], "place": np.arange(1, len(merged) + 1)}

    solid = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(*keys, box_id, *COORDS)
    return map_groups(solid, keys, [box_id], order_page, schema)


def flatten_list(items: DataFrame, list_id: str = "list_id", order: str = "item_no") -> DataFrame:
    """List items with indent and marker; counters run per list, indents from the root level.

    Items carry root_id, list_id, level, ordered, start and text; ``order`` runs through the
    whole root list.
    """
    root = items.groupBy("root_id").agg(F.min("level").alias("_root"))
    shown = items.where(F.trim("text") != "")
    numbered = scan(shown.withColumn("_one", F.lit(1).cast("long")), [list_id], [order], position_bucket(order), sums={"_i": F.col("_one")})
    joined = numbered.join(root, "root_id")
    marker = F.when(F.col("ordered"), F.concat((F.col("start") + F.col("_i") - 1).cast("string"), F.lit(". "))).otherwise("- ")
    return joined.select(
        "root_id", list_id, order, F.concat(F.repeat(F.lit("    "), (F.col("level") - F.col("_root")).cast("int")), marker, F.col("text")).alias("line")
    )


# ---------------------------------------------------------------- sinks
def without_furniture(blocks: DataFrame, furniture: Sequence[str] = tuple(P.FURNITURE_TYPES)) -> DataFrame:
    return blocks.where(~F.col("type").isin(list(furniture)))


def markdown_documents(blocks: DataFrame, order: str = "line_no", text_only: bool = False) -> DataFrame:
    """One Markdown text per document, blocks parted by a blank line.

    Page furniture is left out; ``text_only`` also leaves out images, charts and tables. A
    document's text is one stored value, so it is assembled as one.
    """
    kept = without_furniture(blocks)
    if text_only:
        kept = kept.where(~F.col("type").isin("image", "chart", "table"))
    body = X.escape_block_prefix(X.escape_markdown("text"))
    shown = F.when(F.col("type") == "title", F.concat(F.lit("# "), X.escape_markdown("text"))).when(F.col("type") == "table", F.col("text")).otherwise(body)
    drawn = kept.select("doc_id", order, shown.alias("_t")).where(F.trim("_t") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda s: s["_t"]), "\n\n")
    return drawn.groupBy("doc_id").agg(joined.alias("markdown"))


def content_list(blocks: DataFrame, width: float, height: float, order: str = "line_no") -> DataFrame:
    """Flat typed items as JSON, one row per block, boxes on the 0..1000 page scale."""
    kind = F.when(F.col("type") == "title", "text").otherwise(F.col("type"))
    level = F.when(F.col("type") == "title", 1)
    box = B.page_scale(B.box(), width, height)
    item = F.to_json(F.struct(kind.alias("type"), F.col("text"), level.alias("text_level"), F.array(*[box[c] for c in COORDS]).alias("bbox"), "page_idx"))
    return without_furniture(blocks).select("doc_id", "page_idx", order, item.alias("item"))


def paged_content_list(items: DataFrame, order: str = "line_no") -> DataFrame:
    """Items of each page as one JSON array."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda s: s["item"])
    return items.groupBy("doc_id", "page_idx").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("items"))
