"""Tables of a text as rows of their own, and as chunks to be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.operators.page_tables import cell_grid

SHORTEST = 20


def spread_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, col_no, text) of every place of the grid: a spanning cell shows in all places it covers.

    Where cells of damaged markup overlap, the later one shows. Places below the last row are left out.
    """
    placed = cells.join(cell_grid(cells, keys).select(*keys, "row_no", "col_no", "start_col"), [*keys, "row_no", "col_no"])
    last = cells.groupBy(*keys).agg(F.max("row_no").alias("_last"))
    row = F.explode(F.sequence(F.col("row_no"), F.least(F.col("row_no") + F.col("rowspan") - 1, F.col("_last"))))
    down = placed.join(last, keys).withColumn("_row", row)
    wide = down.withColumn("_col", F.explode(F.sequence(F.col("start_col"), F.col("start_col") + F.col("colspan") - 1)))
    shown = wide.groupBy(*keys, "_row", "_col").agg(F.max_by("text", F.struct("row_no", "col_no")).alias("text"))
    return shown.select(*keys, F.col("_row").alias("row_no"), F.col("_col").alias("col_no"), "text")


def extract_tables(lines: DataFrame, documents: DataFrame, shortest: int = SHORTEST, **patterns) -> DataFrame:
    """Tables of the texts: (doc_id, table_index, line_no, table_number, title, page, content).

    ``lines`` has doc_id, line_no and line (a table is one line of markup, its title the nearest line
    above), ``documents`` doc_id and page_count (null counts as 1). The content is the title and the
    pipe table, spanning cells repeated; the page is estimated from the place in the text. Tables
    with less than ``shortest`` characters are left out, and the index counts those that stay.
    """
    found = chunking.tables_in_text(lines, **patterns)
    keys = ["doc_id", "line_no"]
    cells = chunking.table_cells(found, keys, "line")
    drawn = chunking.gfm_table(spread_cells(cells, keys), keys)
    pages = documents.select("doc_id", F.coalesce("page_count", F.lit(1)).alias("_pages"))
    content = F.concat(F.coalesce(F.concat("title", F.lit("\n\n")), F.lit("")), F.col("markdown"))
    rows = found.join(drawn, keys).join(pages, "doc_id").select(
        *keys, F.col("number").alias("table_number"), "title", chunking.estimated_page(F.col("offset_share"), F.col("_pages")).alias("page"), content.alias("content")
    )
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1  # the tables of one text
    return rows.where(F.length("content") >= shortest).withColumn("table_index", index.cast("long")).select("doc_id", "table_index", "line_no", "table_number", "title", "page", "content")


def table_chunks(tables: DataFrame, documents: DataFrame) -> DataFrame:
    """The tables as parent chunks: page range, place among the document's tables, and the document's own fields for filters."""
    chunks = tables.select(
        "doc_id", F.lit("parent").alias("chunk_type"), F.lit("table").alias("content_type"), "content", F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        F.col("table_index").alias("position"), "table_number", F.col("title").alias("table_title"),
    )
    return chunks.join(documents.drop("page_count"), "doc_id")
