"""Tables taken out of texts, and lists taken out of answers."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.functions import text as X  # noqa: E402
from docloom.operators import text_tables  # noqa: E402


def test_tables_of_a_text(spark):
    texts = {
        1: ["intro", "表 A2 Ratings", "", '<table><tr><th>no</th><th colspan="2">kV | kA</th></tr><tr><td rowspan="3">1</td><td>a<br>b</td><td>c</td></tr><tr><td>d</td></tr></table>', "text", "<table><tr><td>x</td></tr></table>"],
        2: ["续表1", "<TABLE border=1><tr><td>some longer cell of text</td></tr></TABLE>", "no table here"],
        3: ["nothing"],
    }
    lines = spark.createDataFrame([(d, n, t) for d, ls in texts.items() for n, t in enumerate(ls)], "doc_id long, line_no long, line string")
    docs = spark.createDataFrame([(1, 4, "GB 1"), (2, None, "GB 2"), (3, 9, None)], "doc_id long, page_count int, standard_no string")
    got = text_tables.extract_tables(lines, docs)
    rows = {(r.doc_id, r.table_index): (r.table_number, r.title, r.page, r.content) for r in got.collect()}
    assert rows == {
        (1, 0): ("A2", "表 A2 Ratings", 1, "表 A2 Ratings\n\n| no | kV \\| kA | kV \\| kA |\n| --- | --- | --- |\n| 1 | ab | c |\n| 1 | d |  |"),
        (2, 0): ("1", "续表1", 1, "续表1\n\n| some longer cell of text |\n| --- |"),
    }  # the third table is shorter than twenty characters
    chunks = text_tables.table_chunks(got, docs).orderBy("doc_id").collect()
    assert [(c.doc_id, c.content_type, c.position, c.standard_no, c.page_start) for c in chunks] == [(1, "table", 0, "GB 1", 1), (2, "table", 0, "GB 2", 1)]


def test_overlapping_cells_show_the_later_one(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 1, "a"), (1, 0, 1, 1, 2, "down"), (1, 1, 0, 2, 1, "wide")], "t long, row_no long, col_no long, colspan int, rowspan int, text string")
    shown = {(r.row_no, r.col_no): r.text for r in text_tables.spread_cells(cells, ["t"]).collect()}
    assert shown == {(0, 0): "a", (0, 1): "down", (1, 0): "wide", (1, 1): "wide"}


def test_lists_in_answers(spark):
    cases = {'["a", "b"]': ["a", "b"], "[]": [], 'so: ["a"] and ["b"]': ["a"], "```json\n[\"x\",\n\"y\"]\n```": ["x", "y"], "[1, 2]": [], '["a", null]': [], '{"a": ["b"]}': ["b"], "none": [], "": [], None: [], '["open"': []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.lenient_json_list("t").alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases
