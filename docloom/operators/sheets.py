"""Tables in sheets: connected cells with a gap tolerance, tolerance choice, subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.components import connected_components
from docloom.operators.grouped import map_sets
from docloom.operators.skew import best_row

NODE_WIDTH = 1 << 20  # more than the columns any sheet has
#: Sheets within this frame are searched in one piece, larger ones over all tasks.
FRAME_ROWS, FRAME_COLS = 4096, 256
#: Pairs of a table and a cell of its rows that are looked at in one step.
PAIRS = 1 << 20
FACTS = ("tables", "hard", "_inner", "_possible", "_sparse", "_single", "_area", "_blank", "_span", "_covered")


def by_frame(cells: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Cells of the sheets that lie within the frame, and those of the others, if there are any."""
    cells = cells.select("sheet_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    inside = F.coalesce(F.col("row").between(0, FRAME_ROWS - 1) & F.col("col").between(0, FRAME_COLS - 1) & F.col("sheet_id").isNotNull(), F.lit(False))
    large = cells.where(~inside).select("sheet_id").distinct()
    if large.isEmpty():
        return cells, None
    same = F.col("c.sheet_id").eqNullSafe(F.col("l.sheet_id"))
    pick = lambda how: cells.alias("c").join(large.alias("l"), same, how)
    return pick("left_anti"), pick("left_semi")


def linked(sheet: np.ndarray, row: np.ndarray, col: np.ndarray, reach: int) -> np.ndarray:
    """Place of the first cell of each cell's group; cells are sorted by sheet, row and column."""
    right = np.flatnonzero((sheet[1:] == sheet[:-1]) & (row[1:] == row[:-1]) & (col[1:] - col[:-1] <= reach))
    order = np.lexsort((row, col, sheet))
    s, r, c = sheet[order], row[order], col[order]
    down = np.flatnonzero((s[1:] == s[:-1]) & (c[1:] == c[:-1]) & (r[1:] - r[:-1] <= reach))
    a, b, label = np.r_[right, order[down]], np.r_[right + 1, order[down + 1]], np.arange(len(row))
    while True:
        least, moved = np.minimum(label[a], label[b]), label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(moved, at, least)
        moved = moved[moved]
        if np.array_equal(moved, label):
            return label
        label = moved


def boxes_of(sheet: np.ndarray, row: np.ndarray, col: np.ndarray, tolerance: int) -> dict[str, np.ndarray]:
    """Tables of sorted cells: sheet, table_id, rectangle and number of cells."""
    label = linked(sheet, row, col, tolerance + 1)
    first, number = np.unique(label, return_inverse=True)
    out = {"sheet": sheet[first], "table_id": row[first] * NODE_WIDTH + col[first]}
    for axis, values in (("row", row), ("col", col)):
        low, high = values[first].copy(), values[first].copy()
        np.minimum.at(low, number, values)
        np.maximum.at(high, number, values)
        out[f"min_{axis}"], out[f"max_{axis}"] = low, high
    return out | {"cells": np.bincount(number, minlength=len(first))}


def used_lines(table: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different lines of each of ``n`` tables, and whether two blank ones lie between two of them."""
    pairs = np.unique(table * NODE_WIDTH + line)
    of, at = pairs // NODE_WIDTH, pairs % NODE_WIDTH
    gap = (of[1:] == of[:-1]) & (at[1:] - at[:-1] > 2)
    return np.bincount(of, minlength=n), np.bincount(of[1:][gap], minlength=n) > 0


def table_steps(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of tables whose rows hold up to ``PAIRS`` cells, one table at least."""
    upto, at = np.cumsum(high - low), 0
    while at < len(low):
        end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        yield at, end
        at = end


def sheet_facts(sheet: np.ndarray, row: np.ndarray, col: np.ndarray, tolerance: int, sheets: int) -> dict[str, np.ndarray]:
    """The sums per sheet that its penalty is made of (``FACTS``), at one gap tolerance."""
    t = boxes_of(sheet, row, col, tolerance)
    place, base = sheet * FRAME_ROWS + row, t["sheet"] * FRAME_ROWS
    low, high = np.searchsorted(place, base + t["min_row"]), np.searchsorted(place, base + t["max_row"], "right")
    content, rows_used, cols_used, hard = (np.zeros(len(low), np.int64) for _ in range(4))
    for s, e in table_steps(low, high):
        size = high[s:e] - low[s:e]
        table = np.repeat(np.arange(e - s), size)
        cell = np.arange(len(table)) - np.repeat(np.cumsum(size) - size, size) + low[s:e][table]
        inside = (col[cell] >= t["min_col"][s:e][table]) & (col[cell] <= t["max_col"][s:e][table])
        table, cell = table[inside], cell[inside]
        content[s:e] = np.bincount(table, minlength=e - s)
        (rows_used[s:e], wide), (cols_used[s:e], tall) = used_lines(table, row[cell], e - s), used_lines(table, col[cell], e - s)
        hard[s:e] = wide | tall
    height, width = t["max_row"] - t["min_row"] + 1, t["max_col"] - t["min_col"] + 1
    area = height * width
    blank = 1 - content / area
    order = np.lexsort((t["min_row"], t["sheet"]))
    start, end = (base + t["min_row"])[order], (base + t["max_row"])[order]
    reached = np.r_[-1, np.maximum.accumulate(end)[:-1]]
    covered = np.maximum(end - np.maximum(reached, start - 1), 0)
    total = lambda values, of=t["sheet"]: np.bincount(of, values, minlength=sheets)
    sums = (
        np.ones(len(low)), hard, np.where(height > 2, height - rows_used, 0) + np.where(width > 2, width - cols_used, 0), np.maximum(height - 2, 0) + np.maximum(width - 2, 0),
        (area >= 6) & (blank > 0.35), area == 1, area, area * blank, height,
    )
    facts = dict(zip(FACTS, [total(v) for v in sums] + [total(covered, t["sheet"][order])], strict=True))
    return {n: v if n == "_blank" else v.round().astype(np.int64) for n, v in facts.items()}


def sorted_cells(rows: pd.DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sheet number, row and column of the different cells of a set of sheets."""
    sheet = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
    row, col = rows["row"].to_numpy(), rows["col"].to_numpy()
    new = np.r_[True, (np.diff(sheet) != 0) | (np.diff(row) != 0) | (np.diff(col) != 0)]
    return sheet[new], row[new], col[new]


def find_tables(cells: DataFrame, tolerances: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Bounding box of each connected group of cells, for every gap tolerance.

    Cells are linked along a row or column when at most ``tolerance`` blanks lie between.
    Sheets within the frame are searched many at a time, in one shuffle; of larger ones
    the cells are linked by joins. Rows (sheet_id, tolerance, table_id,
    min_row, max_row, min_col, max_col, cells); table_id names the first cell.
    """
    small, large = by_frame(cells)
    names = ["table_id", "min_row", "max_row", "min_col", "max_col", "cells"]
    schema = T.StructType([small.schema["sheet_id"], T.StructField("tolerance", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)])

    def finish(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids, placed, out = rows["sheet_id"].to_numpy()[starts], sorted_cells(rows, starts), []
        for tolerance in tolerances:
            t = boxes_of(*placed, tolerance)
            out.append(pd.DataFrame({"sheet_id": ids[t["sheet"]], "tolerance": np.int32(tolerance), **{n: t[n] for n in names}}))
        return pd.concat(out, ignore_index=True)

    found = map_sets(small, ["sheet_id"], ["row", "col"], finish, schema)
    return found if large is None else found.unionByName(find_linked(large, tolerances))


def find_linked(cells: DataFrame, tolerances: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """``find_tables`` for sheets of any size: neighbours are looked up by shifted coordinates."""
    base = cells.select("sheet_id", "row", "col", F.explode(F.array(*[F.lit(t) for t in tolerances])).alias("tolerance"))
    too_wide = F.raise_error(F.concat(F.lit("column number beyond 2**20: "), F.col("col").cast("string"))).cast("long")
    base = base.withColumn("node", F.when(F.col("col") < NODE_WIDTH, F.col("row") * NODE_WIDTH + F.col("col")).otherwise(too_wide))
    reach = F.explode(F.sequence(F.lit(1), F.col("tolerance") + 1))
    down = base.withColumn("_d", reach).select("sheet_id", "tolerance", F.col("node").alias("a"), (F.col("node") + F.col("_d") * NODE_WIDTH).alias("b"))
    right = base.withColumn("_d", reach).select("sheet_id", "tolerance", F.col("node").alias("a"), (F.col("node") + F.col("_d")).alias("b"))
    wanted = down.unionByName(right)
    edges = wanted.join(base.select("sheet_id", "tolerance", F.col("node").alias("b")), ["sheet_id", "tolerance", "b"], "left_semi")
    groups = connected_components(base, edges, ["sheet_id", "tolerance"])
    placed = groups.select("sheet_id", "tolerance", F.col("component").alias("table_id"), F.floor(F.col("node") / NODE_WIDTH).alias("row"), (F.col("node") % NODE_WIDTH).alias("col"))
    return placed.groupBy("sheet_id", "tolerance", "table_id").agg(
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count("*").alias("cells")
    )


def table_content(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Filled cells inside each table's rectangle: the rows it spans joined to the sheet's cells."""
    spans = tables.select("sheet_id", "tolerance", "table_id", "min_col", "max_col", F.explode(F.sequence("min_row", "max_row")).alias("row"))
    return spans.join(cells.select("sheet_id", "row", "col"), ["sheet_id", "row"]).where(F.col("col").between(F.col("min_col"), F.col("max_col"))).select(
        "sheet_id", "tolerance", "table_id", "row", "col"
    )


def choose_tolerance(tables: DataFrame, cells: DataFrame, margin: float = 0.15) -> DataFrame:
    """Tolerance per sheet by penalty; near ties prefer fewer hard separators, then 1, 0, 2."""
    key = ["sheet_id", "tolerance", "table_id"]
    content = table_content(tables, cells)
    filled = content.groupBy(*key).agg(F.count("*").alias("content"), F.count_distinct("row").alias("rows_used"), F.count_distinct("col").alias("cols_used"))

    def hard_gap(axis: str) -> DataFrame:
        """Tables with two blank lines in a row: a used line with neither of the next two used."""
        used = content.select(*key, axis).distinct()
        near = used.select(*key, F.explode(F.array(F.col(axis) - 1, F.col(axis) - 2)).alias(axis)).distinct()
        last = used.groupBy(*key).agg(F.max(axis).alias("_last"))
        return used.join(near, [*key, axis], "left_anti").join(last, key).where(F.col(axis) < F.col("_last")).select(*key).distinct()

    hard = hard_gap("row").unionByName(hard_gap("col")).distinct().withColumn("_hard", F.lit(1))
    t = tables.join(filled, key).join(hard, key, "left")
    height, width = F.col("max_row") - F.col("min_row") + 1, F.col("max_col") - F.col("min_col") + 1
    area = height * width
    blank = 1 - F.col("content") / area
    inner = F.when(height > 2, height - F.col("rows_used")).otherwise(0) + F.when(width > 2, width - F.col("cols_used")).otherwise(0)
    possible = F.greatest(height - 2, F.lit(0)) + F.greatest(width - 2, F.lit(0))
    sheet = t.groupBy("sheet_id", "tolerance").agg(
        F.count("*").alias("tables"), F.coalesce(F.sum("_hard"), F.lit(0)).alias("hard"), F.sum(inner).alias("_inner"), F.sum(possible).alias("_possible"),
        F.count_if((area >= 6) & (blank > 0.35)).alias("_sparse"), F.count_if(area == 1).alias("_single"), F.sum(area).alias("_area"), F.sum(area * blank).alias("_blank"),
    )
    covered = tables.select("sheet_id", "tolerance", F.explode(F.sequence("min_row", "max_row")).alias("row")).groupBy("sheet_id", "tolerance", "row").agg(F.count("*").alias("n"))
    overlap = covered.groupBy("sheet_id", "tolerance").agg((F.sum(F.greatest(F.col("n") - 1, F.lit(0))) / F.count("*")).alias("_overlap"))
    rated = sheet.join(overlap, ["sheet_id", "tolerance"]).select("sheet_id", "tolerance", *rates(F.col, F.col("_overlap")))
    best = rated.groupBy("sheet_id").agg(F.min("penalty").alias("_min"))
    near = rated.join(best, "sheet_id").where(F.round(F.col("penalty") - F.col("_min"), 6) <= margin)
    return best_row(near, ["sheet_id"], [F.asc("hard"), preference(F.col("tolerance")).asc(), F.asc("lines"), F.asc("penalty")]).select("sheet_id", "tolerance", "tables", "penalty")


def preference(tolerance: Column) -> Column:
    return F.when(tolerance == 1, 0).when(tolerance == 0, 1).otherwise(2)


def rates(of, overlap: Column) -> list[Column]:
    """Tables, hard separators, share of blank lines and penalty, from the sums of a sheet."""
    lines = of("_inner") / F.greatest(of("_possible"), F.lit(1))
    penalty = (
        6.0 * of("hard") + 2.5 * lines + 1.5 * of("_sparse") / of("tables") + 1.0 * of("_single") / of("tables")
        + 0.5 * of("_blank") / F.greatest(of("_area"), F.lit(1)) + 1.0 * overlap
    )
    return [of("tables").alias("tables"), of("hard").alias("hard"), F.round(lines, 6).alias("lines"), F.round(penalty, 6).alias("penalty")]


def best_tolerance(cells: DataFrame, tolerances: tuple[int, ...] = (0, 1, 2), margin: float = 0.15) -> DataFrame:
    """``choose_tolerance`` of the tables of ``cells``.

    The sums of a sheet within the frame are made where its tables are found, one row per
    sheet; larger sheets go through ``choose_tolerance``.
    """
    small, large = by_frame(cells)
    kinds = [T.StructField(f"{n}{t}", T.DoubleType() if n == "_blank" else T.LongType()) for t in tolerances for n in FACTS]

    def finish(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        placed, out = sorted_cells(rows, starts), {"sheet_id": rows["sheet_id"].to_numpy()[starts]}
        for t in tolerances:
            out |= {f"{n}{t}": v for n, v in sheet_facts(*placed, t, len(starts)).items()}
        return pd.DataFrame(out)

    sums = map_sets(small, ["sheet_id"], ["row", "col"], finish, T.StructType([small.schema["sheet_id"], *kinds]))
    rated = []
    for t in tolerances:
        of = lambda n, t=t: F.col(f"{n}{t}")
        tables, hard, lines, penalty = rates(of, (of("_span") - of("_covered")) / of("_covered"))
        rated.append(F.struct(hard, preference(F.lit(t)).alias("p"), lines, penalty, F.lit(t).alias("tolerance"), tables))
    listed = sums.select("sheet_id", F.array(*rated).alias("r"))
    least = F.array_min(F.transform("r", lambda x: x["penalty"]))
    near = listed.withColumn("_min", least).select("sheet_id", F.array_min(F.filter("r", lambda x: F.round(x["penalty"] - F.col("_min"), 6) <= margin)).alias("b"))
    chosen = near.select("sheet_id", "b.tolerance", "b.tables", "b.penalty")
    return chosen if large is None else chosen.unionByName(choose_tolerance(find_linked(large, tolerances), large, margin))


def drop_subset_tables(tables: DataFrame, content: DataFrame) -> DataFrame:
    """Tables whose filled cells are not a proper subset of another table's.

    Tables meet through shared cells; one is a subset when all its cells are shared.
    """
    key = ["sheet_id", "tolerance"]
    sizes = content.groupBy(*key, "table_id").agg(F.count("*").alias("_n"))
    other = content.withColumnRenamed("table_id", "_other")
    shared = content.join(other, [*key, "row", "col"]).where(F.col("table_id") != F.col("_other")).groupBy(*key, "table_id", "_other").agg(F.count("*").alias("_shared"))
    rated = shared.join(sizes, [*key, "table_id"]).join(sizes.select(*key, F.col("table_id").alias("_other"), F.col("_n").alias("_m")), [*key, "_other"])
    gone = rated.where((F.col("_shared") == F.col("_n")) & (F.col("_m") > F.col("_n"))).select(*key, "table_id").distinct()
    return tables.join(gone, [*key, "table_id"], "left_anti")
