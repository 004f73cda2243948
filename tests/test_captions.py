"""Fragments of captions on small pages."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.operators import captions  # noqa: E402

BLOCKS = "doc_id long, page_idx long, block_idx long, type string, x0 int, y0 int, x1 int, y1 int, text string, lines int"


def test_fragments(spark):
    pages = {
        "stack": [("caption", 0, 10), ("text", 12, 20), ("header", 13, 15), ("footnote", 22, 30), ("table", 34, 90)],
        "two lines are body text": [("caption", 0, 10), ("text", 12, 40, 2), ("table", 44, 90)],
        "gap": [("caption", 0, 10), ("text", 40, 50), ("table", 54, 90)],
        "tall parts bridge a gap": [("caption", 0, 30), ("text", 60, 70), ("text", 72, 112), ("table", 150, 190)],
        "note of a table further up": [("table", 0, 20), ("footnote", 22, 30), ("caption", 32, 40), ("table", 44, 90)],
        "line": [("caption", 0, 10), ("page_number", 0, 1), ("text", 1, 9), ("image", 12, 90)],
        "head": [("header", 0, 5), ("text", 6, 14, 1, "Table 2 (Continued)"), ("text", 16, 24, 1, "continued"), ("table", 26, 90)],
        "not at the head": [("text", 0, 5, 1, "other"), ("text", 6, 14, 1, "(continued)"), ("table", 26, 90)],
        "discontinued": [("text", 6, 14, 1, "discontinued"), ("table", 16, 90)],
        "head too far": [("text", 0, 8, 1, "(continued)"), ("text", 80, 88, 1, "(continued)"), ("table", 90, 99)],
    }
    rows = [(0, n, i, b[0], 0, b[1], 100, b[2], (b[4:] or ("x",))[0], (b[3:] or (None,))[0]) for n, page in enumerate(pages.values()) for i, b in enumerate(page)]
    got = captions.caption_fallbacks(spark.createDataFrame(rows, BLOCKS), ["table", "image"], bucket=2).orderBy("page_idx", "block_idx").collect()
    changed = {name: [r.block_idx for r in got if r.page_idx == n and r.new_type != r.type] for n, name in enumerate(pages)}
    assert changed == {
        "stack": [1, 3], "two lines are body text": [], "gap": [], "tall parts bridge a gap": [1, 2], "note of a table further up": [],
        "line": [2], "head": [1, 2], "not at the head": [], "discontinued": [], "head too far": [],
    }


def test_fragments_beside_the_table_only(spark):
    rows = [(0, 0, 0, "caption", 0, 0, 50, 10, "c", 1), (0, 0, 1, "text", 400, 12, 450, 20, "t", 1), (0, 0, 2, "text", 0, 12, 50, 20, "t", 1), (0, 0, 3, "table", 0, 24, 100, 90, "", 1)]
    got = captions.caption_fallbacks(spark.createDataFrame(rows, BLOCKS), ["table"]).orderBy("block_idx").collect()
    assert [r.new_type for r in got] == ["caption", "text", "caption", "table"]
