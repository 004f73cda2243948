"""Tables across pages: row geometry, merge chains, repeated headers, column alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.grouped import map_groups
from docloom.operators.ordered import position_bucket, scan

MAX_HEADER_ROWS = 5


def row_geometry(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns each table row covers: rows (keys, row_no, effective_cols, actual_cols, visual_cols).

    Cells of earlier rows reach down by their rowspan and push later cells right, so rows of
    one table are walked in order. One table is one stored markup value.
    """
    schema = T.StructType([
        *[cells.schema[k] for k in keys], T.StructField("row_no", T.LongType()), T.StructField("effective_cols", T.IntegerType()),
        T.StructField("actual_cols", T.IntegerType()), T.StructField("visual_cols", T.IntegerType()),
    ])

    def walk(g: dict) -> dict:
        held: dict[int, int] = {}  # column -> rows it stays taken
        rows, first = np.unique(g["row_no"], return_index=True)
        out = []
        for s, e in zip(first, np.append(first[1:], len(g["row_no"]))):
            reach, at = dict(held), 0
            for colspan, rowspan in zip(g["colspan"][s:e], g["rowspan"][s:e]):
                while at in held:
                    at += 1
                for col in range(at, at + colspan):
                    reach[col] = max(reach.get(col, 0), rowspan)
                at += colspan
            out.append((max(reach) + 1 if reach else 0, g["colspan"][s:e].sum(), e - s))
            held = {col: n - 1 for col, n in reach.items() if n > 1}
        effective, actual, visual = (np.array(v, dtype=np.int32) for v in zip(*out))
        return {"row_no": rows.astype(np.int64), "effective_cols": effective, "actual_cols": actual, "visual_cols": visual}

    columns = cells.select(*keys, "row_no", "col_no", "colspan", "rowspan")
    return map_groups(columns, keys, ["row_no", "col_no"], walk, schema)


def table_metrics(geometry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total columns and the first and last row of each table."""
    row = F.struct("effective_cols", "actual_cols", "visual_cols")
    return geometry.groupBy(*keys).agg(
        F.max("effective_cols").alias("total_cols"), F.count("*").alias("n_rows"),
        F.min_by(row, "row_no").alias("first_row"), F.max_by(row, "row_no").alias("last_row"),
    )


def row_signatures(cells: DataFrame, keys: Sequence[str], rows: int = MAX_HEADER_ROWS) -> DataFrame:
    """Text and span signature of the leading rows of each table."""
    text = F.lower(F.regexp_replace("text", r"\s+", ""))
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("col_no", F.concat_ws("|", F.col("colspan").cast("string"), F.col("rowspan").cast("string"), text).alias("s")))), lambda x: x["s"]
    )
    return cells.where(F.col("row_no") < rows).groupBy(*keys, "row_no").agg(F.array_join(listed, "\u0001").alias("signature"))


def can_continue(prev: str = "_p") -> Column:
    """Whether a table goes on from the one before it.

    They face each other over a page break; a caption must say so and then one footnote may
    stand between, without caption none; widths differ by less than 10 %; and the column
    totals, or the columns of the rows that meet, are equal.
    """
    p = lambda c: F.col(f"{prev}.{c}")
    facing = F.col("first_on_page") & p("last_on_page") & (F.col("page_idx") == p("page_idx") + 1)
    notes = F.when(F.col("captions") > 0, F.col("continued") & (p("footnotes") <= 1)).otherwise(p("footnotes") == 0)
    w, pw = F.col("x1") - F.col("x0"), p("x1") - p("x0")
    alike = F.abs(w - pw) / F.least(w, pw) < 0.1
    meets = (p("last_row.effective_cols") == F.col("first_row.effective_cols")) | (p("last_row.actual_cols") == F.col("first_row.actual_cols"))
    return F.coalesce(facing & notes & alike & ((p("total_cols") == F.col("total_cols")) | meets), F.lit(False))


def merge_chains(tables: DataFrame, order: str = "table_no", bucket: int = 1024) -> DataFrame:
    """Chain number of each table of a document; a table that continues another shares its chain.

    ``before`` is the number of the table before it; numbers may have gaps.

    Tables carry doc_id, page_idx, x0, x1, first_on_page, last_on_page, captions, continued,
    footnotes and the metrics of ``table_metrics``.
    """
    view = F.struct("page_idx", "x0", "x1", "last_on_page", "footnotes", "total_cols", "last_row", F.col(order).alias("number"))
    seen = scan(tables, ["doc_id"], [order], position_bucket(order, bucket), previous={"_p": view})
    opened = seen.withColumn("joined", can_continue()).withColumn("_o", (~F.col("joined")).cast("long"))
    return scan(opened, ["doc_id"], [order], position_bucket(order, bucket), sums={"chain": F.col("_o")}).withColumn("before", F.col("_p.number")).drop("_p", "_o")


def repeated_header_rows(chains: DataFrame, signatures: DataFrame, key: str = "table_no") -> DataFrame:
    """How many leading rows of each joined table repeat the table before it."""
    before = chains.where("joined").select("doc_id", key, F.col("before").alias("_before"))
    own = before.join(signatures.withColumnRenamed("signature", "_own"), ["doc_id", key])
    other = signatures.select("doc_id", F.col(key).alias("_before"), "row_no", F.col("signature").alias("_other"))
    lined = own.join(other, ["doc_id", "_before", "row_no"], "left")
    differs = F.min(F.when(F.col("_own").eqNullSafe(F.col("_other")), None).otherwise(F.col("row_no")))
    return lined.groupBy("doc_id", key).agg(F.coalesce(differs, F.max("row_no") + 1).cast("long").alias("header_rows"))


def merged_rows(chains: DataFrame, cells: DataFrame, geometry: DataFrame, headers: DataFrame, key: str = "table_no") -> DataFrame:
    """Cells of the merged tables: repeated headers gone, short rows widened at their last cell.

    A row that covers fewer columns than its chain is stretched by the difference.
    """
    tagged = chains.select("doc_id", key, "chain", "joined").join(headers, ["doc_id", key], "left")
    width = chains.groupBy("doc_id", "chain").agg(F.max("total_cols").alias("_target"))
    rows = cells.join(tagged, ["doc_id", key]).where(F.col("row_no") >= F.coalesce("header_rows", F.lit(0)))
    rows = rows.join(width, ["doc_id", "chain"]).join(geometry.select("doc_id", key, "row_no", "effective_cols", "actual_cols"), ["doc_id", key, "row_no"])
    w = Window.partitionBy("doc_id", key, "row_no")
    last = F.col("col_no") == F.max("col_no").over(w)
    missing = F.when((F.col("effective_cols") < F.col("_target")) & (F.col("actual_cols") < F.col("_target")), F.col("_target") - F.col("effective_cols")).otherwise(0)
    return rows.withColumn("colspan", F.when(last, F.col("colspan") + missing).otherwise(F.col("colspan"))).select(
        "doc_id", "chain", key, "row_no", "col_no", "colspan", "rowspan", "text"
    )
