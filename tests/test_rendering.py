"""Markdown and typed items of one block of every kind."""

from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.operators import rendering  # noqa: E402

SPAN = "array<struct<kind:string,content:string>>"
BLOCKS = f"doc_id long, page_idx long, block_no long, type string, spans {SPAN}, level int, sub_type string, lang string, image_path string, x0 double, y0 double, x1 double, y1 double"
PARTS = f"doc_id long, block_no long, part_no long, kind string, spans {SPAN}, html string, image_path string, content string"


def text(t, kind="text"):
    return [(kind, t)]


@pytest.fixture(scope="module")
def page(spark):
    made = [
        ("title", text("A *big* one"), 2, None, None, None), ("text", [("text", "let "), ("inline_equation", "a_b*c"), ("text", "be_it"), ("inline_equation", " ")], None, None, None, None),
        ("interline_equation", text(r"\frac{a_b}{c}"), None, None, None, "e.png"), ("interline_equation", [], None, None, None, "f.png"),
        ("list", [("item", "one."), ("item", "two_"), ("text", "more")], None, None, None, None), ("text", text("# no heading"), None, None, None, None),
        ("image", None, None, "flow chart", None, None), ("table", None, None, None, None, None), ("chart", None, None, None, None, None), ("code", None, None, "code", "python", None),
        ("header", text("running head"), None, None, None, None), ("ref_text", [("item", "[1] A_"), ("item", " "), ("item", "[2] B")], None, None, None, None), ("text", [], None, None, None, None),
        ("title", text(" "), 1, None, None, None), ("code", None, None, "algorithm", None, None), ("text", [("text", "see"), ("interline_equation", "x"), ("text", "here")], None, None, None, None),
    ]
    parts = [
        (6, 1, "caption", text("Fig. 1"), None, None, None), (6, 0, "body", None, None, "a.png", " says\nthis "), (6, 2, "footnote", text("note"), None, None, None),
        (7, 0, "caption", text("Table_1"), None, None, None), (7, 1, "body", None, '<table><tr><td><eq>a &lt; b</eq></td><td><img src="c.png"></td></tr></table>', "t.png", None), (7, 2, "footnote", text("n"), None, None, None),
        (8, 0, "body", None, None, "g.png", None), (8, 1, "caption", text(""), None, None, None),
        (9, 0, "caption", text("Listing"), None, None, None), (9, 1, "body", [("text", "if a_b:  "), ("text", "    pass")], None, None, None), (14, 0, "body", [("text", "step_1")], None, None, None),
    ]
    blocks = spark.createDataFrame([(1, 0, n, *b, 60.0, 80.0, 300.0, 400.0) for n, b in enumerate(made)], BLOCKS)
    return blocks, spark.createDataFrame([(1, *p) for p in parts], PARTS)


def test_markdown_of_every_kind(page):
    got = {r.block_no: r.markdown for r in rendering.block_markdown(*page).collect()}
    assert got == {
        0: r"## A \*big\* one", 1: r"let $a_b*c$ be\_it", 2: "$$\n\\frac{a_b}{c}\n$$", 3: "![](images/f.png)", 4: "one.  \ntwo\\_ more", 5: r"\# no heading",
        6: "![](images/a.png)\n\n<details>\n<summary>flow chart</summary>\n\nsays\nthis\n</details>\n\nFig. 1  \nnote",
        7: 'Table\\_1\n<table><tr><td> $a < b$ </td><td><img src="images/c.png"></td></tr></table>\n\nn', 8: "![](images/g.png)", 9: "Listing  \n```python\nif a_b:\n    pass\n```",
        10: "", 11: "[1] A\\_  \n[2] B", 12: "", 13: "", 14: r"step\_1", 15: "see\n$$\nx\n$$\nhere",
    }
    plain = {r.block_no: r.markdown for r in rendering.block_markdown(*page, text_only=True).collect()}
    assert [plain[n] for n in (6, 7, 8)] == ["", "", ""] and plain[9] == got[9]
    (whole,) = rendering.documents(rendering.block_markdown(*page)).collect()
    assert whole.markdown == "\n\n".join(got[n] for n in sorted(got) if got[n])


def test_items_of_every_kind(page):
    items = rendering.content_items(*page, 600.0, 800.0)
    got = {r.block_no: json.loads(r.item) for r in rendering.json_items(items).collect()}
    assert all(i.pop("bbox") == [100, 100, 500, 500] and i.pop("page_idx") == 0 for i in got.values())
    assert got[0] == {"type": "text", "text": r"A \*big\* one", "text_level": 2}
    assert got[2] == {"type": "equation", "img_path": "images/e.png", "text": "$$\n\\frac{a_b}{c}\n$$", "text_format": "latex"} and got[3] == {"type": "equation", "img_path": "images/f.png"}
    assert got[6] == {"type": "image", "sub_type": "flow chart", "img_path": "images/a.png", "content": "says\nthis", "image_caption": ["Fig. 1"], "image_footnote": ["note"]}
    assert got[7] == {"type": "table", "img_path": "images/t.png", "table_caption": [r"Table\_1"], "table_footnote": ["n"], "table_body": '<table><tr><td> $a < b$ </td><td><img src="images/c.png"></td></tr></table>'}
    assert got[8] == {"type": "chart", "img_path": "images/g.png", "content": "", "chart_caption": [], "chart_footnote": []}
    assert got[9] == {"type": "code", "sub_type": "code", "code_caption": ["Listing"], "code_footnote": [], "code_body": "```python\nif a_b:\n    pass\n```"}
    assert got[10] == {"type": "header", "text": "running head"} and got[11] == {"type": "list", "sub_type": "ref_text", "list_items": [r"[1] A\_", "[2] B"]}
    (pages,) = rendering.json_pages(items).collect()
    assert [i["type"] for i in json.loads(pages["items"])] == [got[n]["type"] for n in sorted(got)]
