"""Steps inside printed pages: nothing is shuffled, results are those of plain loops."""

import random

import pytest

from docloom.operators import pages
from docloom.plans import layout_queries
from docloom.sources.tables import Corpus

BOX = "x0: bigint, y0: bigint, x1: bigint, y1: bigint"


@pytest.mark.parametrize("name", ["char_spans", "char_text", "line_build", "span_blocks"])
def test_words_and_characters_of_a_page_are_not_shuffled(spark, name):
    c = Corpus(spark, "/root/testdata/sf0.001")
    c._splits["documents"] = 1 << 10  # as if it had enough splits to be read as it is
    plan = getattr(layout_queries, name)(c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def boxes(rng, n, wide):
    out = []
    for i in range(n):
        x, y = rng.randrange(-50, 400), rng.randrange(0, 60)
        out.append((i, x, y, x + rng.randrange(0, wide), y + rng.randrange(1, 20)))
    return out


def test_first_block_and_first_span_as_plain_loops_find_them(spark):
    rng = random.Random(5)
    rows = [(p, boxes(rng, rng.randrange(0, 9), 60), boxes(rng, rng.randrange(0, 5), 900)) for p in range(1500)]
    df = spark.createDataFrame(rows, f"page long, spans array<struct<span_no: bigint, {BOX}>>, blocks array<struct<block_idx: bigint, {BOX}>>").repartition(1)
    want = []
    for page, spans, blocks in rows:
        for n, x0, y0, x1, y1 in spans:
            area = (x1 - x0) * (y1 - y0)
            held = [b for b, u0, v0, u1, v1 in blocks if area and max(min(x1, u1) - max(x0, u0), 0) * max(min(y1, v1) - max(y0, v0), 0) / area > 0.5]
            want.append((page, n, min(held, default=None)))
    assert sorted(map(tuple, pages.covering_blocks(df, ["page"]).collect())) == sorted(want)
    marks = [(p, [(i, rng.choice("a.(,"), *b) for i, *b in boxes(rng, rng.randrange(0, 9), 90)], s) for p, s, _ in rows]
    df = spark.createDataFrame(marks, f"page long, chars array<struct<char_idx: bigint, char: string, {BOX}>>, spans array<struct<span_idx: bigint, {BOX}>>").repartition(1)
    want = []
    for page, chars, spans in marks:
        for n, c, x0, y0, x1, y1 in chars:
            x, y = (x0 + x1) / 2, (y0 + y1) / 2
            held = [
                s for s, u0, v0, u1, v1 in spans
                if v0 < y < v1 and abs(y - (v0 + v1) / 2) < (v1 - v0) * 0.33
                and (u0 < x < u1 or (c in ".," and u1 - (v1 - v0) < x0 < u1 and x > u0) or (c == "(" and u0 < x1 < u0 + v1 - v0 and x < u1))
            ]
            want += [(page, n, min(held))] if held else []
    assert sorted(map(tuple, pages.spans_of_chars(df, ["page"]).collect())) == sorted(want)


def test_lines_are_numbered_by_page_and_solo_spans_stand_alone(spark):
    page = [(1, 0, 0, 9, 10, False), (2, 20, 1, 29, 11, False), (3, 40, 2, 49, 12, True), (4, 60, 3, 69, 13, False), (5, 0, 20, 9, 30, False), (6, 0, 25, 9, 25, False)]
    rows = [(p, page) for p in range(600)] + [(600, [])]
    df = spark.createDataFrame(rows, f"page long, spans array<struct<span_no: bigint, {BOX}, solo: boolean>>").repartition(1)
    got = {}
    for page_no, span, line in pages.printed_lines(df, ["page"]).collect():
        got.setdefault(page_no, {})[span] = line
    assert len(got) == 600 and all(g == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5} for g in got.values())


def test_a_box_across_the_columns_is_set_apart(spark):
    from docloom.operators import layout

    left, right = ([(i, x, 12 * row, x + 40, 12 * row + 10) for row, i in enumerate(ids)] for x, ids in ((0, (1, 2, 3)), (60, (4, 5, 6))))
    df = spark.createDataFrame([(1, *b) for b in [*left, *right, (7, 0, 11, 100, 12)]], "page long, box_id long, x0 long, y0 long, x1 long, y1 long")
    assert [r["box_id"] for r in layout.xycut_order(df, ["page"], "box_id").orderBy("place").collect()] == [1, 7, 2, 3, 4, 5, 6]
