import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import chunking, components, graph, layout, nearest, ranking, recall, sheets, tables
from docloom.operators.ordered import position_bucket, scan
from docloom.operators.skew import salted_join


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bucketed_scan_equals_a_plain_walk(spark):
    random.seed(3)
    data = [(k, i, random.choice([None, 1, 2, 5])) for k in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = scan(df, ["k"], ["i"], position_bucket("i", 7), sums={"s": F.col("v")}, fills={"f": F.col("v")}, previous={"p": F.col("v")}, maxes_before={"m": F.col("v")})
    for key in ("a", "b"):
        total, last, prev, top = None, None, None, None
        for r in got.where(F.col("k") == key).orderBy("i").collect():
            assert (r["p"], r["m"]) == (prev, top)
            if r["v"] is not None:
                total, last, top = (total or 0) + r["v"], r["v"], max(top or 0, r["v"])
            prev = r["v"]
            assert (r["s"], r["f"]) == (total, last)


def test_salted_join_keeps_every_pair_once(spark):
    big = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99), (3, 7)], "k long, x long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, y string")
    assert salted_join(big, small, ["k"]).count() == 81
    assert salted_join(big, small, ["k"], "left_anti").count() == 1


def test_salted_join_broadcasts_by_the_size_of_all_copies(spark):
    big, small = spark.range(10).withColumn("x", F.col("id")), spark.range(20000).withColumn("y", F.col("id"))
    hash_joins = lambda right: salted_join(big, right, ["id"], "left")._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
    assert hash_joins(small) == 0 and hash_joins(small.limit(10)) == 1


def test_reciprocal_rank_fusion_numbers(spark):
    hits = [(1, 10, "vector", 0, 0.9), (1, 11, "vector", 0, 0.8), (1, 11, "keyword", 1, 7.0), (1, 12, "keyword", 1, 6.0)]
    df = spark.createDataFrame(hits, "query_id long, chunk_id long, source string, list_no int, score double")
    got = {r["chunk_id"]: r for r in recall.reciprocal_rank_fusion(recall.rank_lists(df)).collect()}
    top = 1 / 62 + 1 / 61
    assert got[11]["sources"] == "vector+keyword" and got[11]["score"] == 1.0 and got[11]["rank"] == 1
    assert abs(got[10]["score"] - (1 / 61) / top) < 1e-6 and got[12]["rank"] == 3


def test_fewer_candidates_than_k_keep_their_order(spark):
    df = spark.createDataFrame([(1, 5, ["q"], ["a"], "text", 0.7), (1, 6, ["q"], ["b"], "text", 0.8)], "query_id long, chunk_id long, query_words array<string>, content_words array<string>, content_type string, score double")
    assert [r["chunk_id"] for r in ranking.two_stage_rerank(df, 5).orderBy("rank").collect()] == [6, 5]


def test_sufficiency_reasons(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    r = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.85), (2, 1, 0.2), (3, 1, 0.4), (3, 2, 0.1)], "query_id long, rank int, final_score double")
    assert rows(ranking.sufficiency(q, r), "query_id") == [(1, True, ""), (2, False, "top1_low"), (3, False, "coverage_low"), (4, False, "empty")]


def test_two_ways_of_vector_search_agree(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "id long, vector array<double>")
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    shipped = rows(nearest.dense_topk(queries, vectors, "id", 4), "query_id", "rank")
    blocked = rows(nearest.dense_topk(queries, vectors, "id", 4, max_shipped=7), "query_id", "rank")
    assert shipped == blocked and len(shipped) == 240


def test_pull_along_prefers_named_figures(spark):
    chunks = spark.createDataFrame([(1, 1, 7, "见图1", "text", 0.5), (1, 2, 7, "plain", "text", 0.9)], "query_id long, chunk_id long, doc_id long, content string, content_type string, score double")
    images = spark.createDataFrame([(7, "图1", 50, 500), (7, "图2", 51, 501)], "doc_id long, figure string, chunk_id long, image_id long")
    related = spark.createDataFrame([(2, 51), (2, 50)], "chunk_id long, related_id long")
    got = rows(ranking.pull_along_images(chunks, images, related), "chunk_id")
    assert got == [(1, 50, 0.4, "pull_along"), (1, 51, 0.72, "pull_along_semantic")]
    linked = ranking.inject_image_links(chunks, images).where("chunk_id = 1").first()
    assert [i["image_id"] for i in linked["images"]] == [500]


def test_images_near_text_by_page_band(spark):
    texts = spark.createDataFrame([(1, 10, 3, 4)], "doc_id long, chunk_id long, page_start int, page_end int")
    images = spark.createDataFrame([(1, p, 100 + p) for p in range(1, 8)], "doc_id long, page int, chunk_id long")
    assert [r[1] for r in rows(ranking.images_near_text(texts, images), "image_id")] == [102, 103, 104, 105]


def boxes(spark, n=60, seed=5, pages=3):
    random.seed(seed)
    data = []
    for i in range(n):
        x, y = random.randint(0, 60), random.randint(0, 60)
        data.append((i % pages, i, float(x), float(y), float(x + random.randint(8, 40)), float(y + random.randint(8, 40)), random.randint(0, 9) / 10, random.choice(["text", "table", "inline_formula"])))
    return spark.createDataFrame(data, "page long, box_id long, x0 double, y0 double, x1 double, y1 double, score double, label string"), data


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)


def test_suppression_equals_the_greedy_walk(spark):
    df, data = boxes(spark)
    kept = []
    for b in sorted(data, key=lambda r: (-r[6], r[1])):
        if all(k[0] != b[0] or iou(k, b) <= 0.3 for k in kept):
            kept.append(b)
    got = layout.suppress_boxes(df, ["page"], "box_id", threshold=0.3, cell=16.0)
    assert sorted(r["box_id"] for r in got.collect()) == sorted(k[1] for k in kept)


def test_containment_drops_both_of_two_equal_boxes(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 9, 9), (1, 2, 0, 0, 9, 9), (1, 3, 20, 20, 30, 30), (1, 4, 21, 21, 25, 25)], "page long, box_id long, x0 int, y0 int, x1 int, y1 int")
    assert [r["box_id"] for r in layout.drop_contained(df, ["page"], 8.0).collect()] == [3]


def test_filtered_and_united_boxes(spark):
    df, data = boxes(spark, 40)
    gone = set()
    for i, j in itertools.combinations(range(len(data)), 2):
        a, b = data[i], data[j]
        if a[0] != b[0] or i in gone or j in gone:
            continue
        w, h = max(min(a[4], b[4]) - max(a[2], b[2]), 0), max(min(a[5], b[5]) - max(a[3], b[3]), 0)
        area = [(r[4] - r[2]) * (r[5] - r[3]) for r in (a, b)]
        ratio, formulas = w * h / min(area), [n for n, r in ((i, a), (j, b)) if r[7] == "inline_formula"]
        if formulas:
            gone.update(formulas if ratio > 0.5 else ())
        elif ratio > 0.7:
            gone.add(j if area[0] >= area[1] else i)
    got = layout.filter_boxes(df, ["page"], "box_id", cell=16.0)
    assert sorted(r["box_id"] for r in got.collect()) == sorted(set(range(len(data))) - gone)
    united = layout.merge_nested_boxes(df, ["page"], "box_id", 0.7, 16.0)
    pairs = layout.overlapping_pairs(united, ["page"], "box_id", 16.0)
    assert pairs.where(layout.B.overlap_min_area(layout.B.box("l_"), layout.B.box("r_")) >= 0.7).count() == 0


def test_chain_of_nested_boxes_becomes_one(spark):
    """A thousand boxes, each in the next larger one, and one apart that the union does not reach."""
    chain = [(1, i, 0.5, 0.0, 0.0, 10.0 + i, 10.0 + i) for i in range(1000)] + [(1, 5000, 0.9, 2000.0, 0.0, 2010.0, 10.0)]
    df = spark.createDataFrame(chain, "page long, box_id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.merge_nested_boxes(df, ["page"], "box_id", 0.7, 4096.0), "box_id") == [(1, 999, 0.5, 0.0, 0.0, 1009.0, 1009.0), (1, 5000, 0.9, 2000.0, 0.0, 2010.0, 10.0)]


def test_united_box_meets_a_further_one(spark):
    boxes_ = [(1, 1, 0.123456, 0.5, 0.0, 10.0, 10.0), (1, 2, 0.2, 1.0, 0.0, 12.0, 12.0), (1, 3, 0.1, 10.0, 9.0, 13.0, 11.0), (2, 1, 0.5, 0.5, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(boxes_, "page long, box_id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.merge_nested_boxes(df, ["page"], "box_id", 0.6, 64.0), "page", "box_id") == [(1, 2, 0.2, 0.0, 0.0, 13.0, 12.0), (2, 1, 0.5, 0.5, 0.0, 10.0, 10.0)]


def test_reading_order_ignores_row_order(spark):
    df, _ = boxes(spark, 30)
    first = rows(layout.xycut_order(df, ["page"], "box_id"), "page", "place")
    second = rows(layout.xycut_order(df.orderBy(F.rand(1)), ["page"], "box_id"), "page", "place")
    assert first == second and len({(p, b) for p, b, _ in first}) == 30
    columns = spark.createDataFrame([(1, 1, 0.0, 0.0, 40.0, 10.0), (1, 2, 60.0, 0.0, 100.0, 10.0), (1, 3, 0.0, 12.0, 40.0, 22.0), (1, 4, 60.0, 12.0, 100.0, 22.0)], "page long, box_id long, x0 double, y0 double, x1 double, y1 double")
    assert [r[1] for r in rows(layout.xycut_order(columns, ["page"], "box_id"), "place")] == [1, 3, 2, 4]


def test_raised_and_spaced_characters(spark):
    chars = [(1, i, ch, 10.0 * i + (5 if i > 3 else 0), 0.0 - (6 if ch == "2" else 0), 10.0 * i + 8 + (5 if i > 3 else 0), 10.0 - (8 if ch == "2" else 0)) for i, ch in enumerate("xm2kab")]
    df = spark.createDataFrame(chars, "span long, char_idx long, char string, x0 double, y0 double, x1 double, y1 double")
    assert layout.chars_to_text(df, ["span"]).first()["content"] == "xm<sup>2</sup>k ab"


def test_interval_merge_and_subtract(spark):
    i = spark.createDataFrame([(1, 1, 4), (1, 4, 6), (1, 9, 12)], "key long, start long, end long")
    assert rows(layout.merge_intervals(i, ["key"]), "start") == [(1, 1, 6), (1, 9, 12)]
    o = spark.createDataFrame([(1, 0, 20)], "key long, start long, end long")
    got = layout.subtract_intervals(o, i, ["key"])
    assert sorted((r["start"], r["end"]) for r in got.collect()) == [(0, 0), (7, 8), (13, 20)]


def test_rowspans_push_cells_right(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 0, 1, 2, 1), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (1, 2, 0, 1, 1)], "t long, row_no long, col_no int, colspan int, rowspan int")
    assert rows(tables.row_geometry(cells, ["t"]), "row_no") == [(1, 0, 3, 3, 2), (1, 1, 3, 2, 2), (1, 2, 1, 1, 1)]


def test_sheet_gap_tolerance_and_subsets(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (1, 4, 0)], "sheet_id long, row long, col long")
    found = sheets.find_tables(cells)
    assert [r[1] for r in rows(found.groupBy("tolerance").count(), "tolerance")] == [3, 2, 2]
    ring = [(1, r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)] + [(1, 2, 2)]
    df = spark.createDataFrame(ring, "sheet_id long, row long, col long")
    t = sheets.find_tables(df, (0,))
    assert t.count() == 2 and sheets.drop_subset_tables(t, sheets.table_content(t, df)).count() == 1


def test_components_and_chains(spark):
    nodes = spark.createDataFrame([(1, n) for n in range(1, 9)], "k long, node long")
    edges = spark.createDataFrame([(1, n, n + 1) for n in (1, 2, 3, 5, 6)], "k long, a long, b long")
    got = components.connected_components(nodes, edges, ["k"])
    assert [r[2] for r in rows(got, "node")] == [1, 1, 1, 1, 5, 5, 5, 8]
    links = spark.createDataFrame([(n, n + 1 if n < 20 else None) for n in range(1, 21)], "doc_id long, replaced_by long")
    assert {(r["final_id"]) for r in graph.resolve_chain(links).collect()} == {20}


def test_parent_of_null_chapter(spark):
    parents = spark.createDataFrame([(1, None, 11, 0), (1, "2", 12, 1), (1, "2", 13, 2)], "doc_id long, chapter string, chunk_id long, position long")
    kids = spark.createDataFrame([(1, None, 21), (1, "2", 22), (1, "9", 23)], "doc_id long, chapter string, chunk_id long")
    assert [(r["chunk_id"], r["parent_id"]) for r in chunking.parent_of_child(parents, kids).orderBy("chunk_id").collect()] == [(21, 11), (22, 12), (23, None)]


def test_fast_lane_retries_only_weak_questions(spark):
    from docloom.plans.lanes import fast_lane

    texts = spark.createDataFrame([(i, f"alpha beta gamma delta number {i} words here", "text") for i in range(1, 6)] + [(9, "nothing of the kind is written in here", "text")], "chunk_id long, content string, content_type string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "zeta eta")], "query_id long, query_text string")
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(1, 4)] + [(2, 9, 0.1)], "query_id long, chunk_id long, score double")
    retry = spark.createDataFrame([(1, 5, 3.0), (2, 4, 2.0)], "query_id long, chunk_id long, score double")
    got = sorted((r["query_id"], r["chunk_id"], r["rounds"]) for r in fast_lane(queries, hits, retry, texts).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 4, 2), (2, 9, 2)]


def test_chains_with_a_circle_have_no_end(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 5), (5, 6), (6, None)], "doc_id long, replaced_by long")
    found = {r["doc_id"]: (r["final_id"], r["steps"]) for r in graph.resolve_chain(links).collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (None, None), 4: (6, 2), 5: (6, 1), 6: (6, 0)}


def test_row_scorer_agrees_with_the_join(spark):
    from docloom.operators import search

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b b d"), (3, ""), (4, "e"), (5, "a d d d")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a b"), (8, "d d a"), (9, "zz")], "query_id long, query_text string")
    words = search.tokenize(docs, "doc_id", "text")
    for operator in ("or", "and"):
        rows = sorted(map(tuple, search.bm25(asked, words, "doc_id", operator).collect()))
        stats = words.agg({"length": "avg"}).first()[0]
        joined = search._bm25_by_join(search.term_weights(search.query_terms(asked), words, 5), words, "doc_id", operator, stats)
        assert rows == sorted(map(tuple, joined.collect()))
    best = search.bm25(asked, words, "doc_id", k=1).collect()
    assert {(r["query_id"], r["doc_id"]) for r in best} == {(7, 1), (8, 5)}


def test_entries_live_for_their_time(spark, tmp_path):
    from docloom.streaming import jobs

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 05:59:59"), ("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-01 01:00:00"), ("a", "2024-01-01 16:00:00")]
    made = spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t AS timestamp) AS t")
    for hour, part in ((0, "t < '2024-01-01 06:00:00'"), (1, "t >= '2024-01-01 06:00:00'")):  # two files, two batches
        made.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
    stream = jobs.table_stream(spark, str(tmp_path), "log", files_per_trigger=1)
    opened = jobs.run_to_table(jobs.fresh_answers(stream, "k", "t", "6 hours"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["k"], str(r["t"])[11:16]) for r in opened.collect()) == [("a", "00:00"), ("a", "10:00"), ("a", "16:00"), ("b", "01:00")]


def test_repeated_header_is_found_over_a_gap_in_the_numbers(spark):
    from docloom.operators import tables

    row = "struct<effective_cols: int, actual_cols: int, visual_cols: int>"
    end = (2, 2, 2)
    made = spark.createDataFrame(
        [(1, 2, 0, 0, 100, True, True, 0, True, 0, 2, end, end), (1, 4, 1, 0, 100, True, True, 0, True, 0, 2, end, end)],
        f"doc_id long, table_no long, page_idx long, x0 long, x1 long, first_on_page boolean, last_on_page boolean, captions int, continued boolean, footnotes int, total_cols int, first_row {row}, last_row {row}",
    )
    chains = tables.merge_chains(made)
    assert [(r["table_no"], r["joined"], r["before"]) for r in chains.orderBy("table_no").collect()] == [(2, False, None), (4, True, 2)]
    signatures = spark.createDataFrame([(1, 2, 0, "h"), (1, 2, 1, "a"), (1, 4, 0, "h"), (1, 4, 1, "b")], "doc_id long, table_no long, row_no int, signature string")
    assert [r["header_rows"] for r in tables.repeated_header_rows(chains, signatures).collect()] == [1]


def test_keywords_are_taken_as_written(spark):
    from docloom.operators import chunking

    docs = spark.createDataFrame([(1, "c++ C++ c 3.3 393")], "doc_id long, text string")
    found = chunking.keyword_scores(docs, {"language": ["C++"], "level": ["3.3"]}).collect()
    assert [(r["category"], r["score"]) for r in found] == [("language", 2), ("level", 1)]


def test_sheets_are_searched_in_one_shuffle_and_large_ones_give_the_same(spark):
    from docloom.operators import sheets

    rng = np.random.default_rng(5)
    rows = {(int(s), int(r), int(c)) for s, r, c in zip(rng.integers(0, 8, 300), rng.integers(0, 14, 300), rng.integers(0, 9, 300), strict=True)}
    wide = {(s, r + (5000 if s % 4 == 0 else 0), c) for s, r, c in rows}
    frame = lambda cells: spark.createDataFrame(sorted(cells), "sheet_id long, row long, col long").cache()
    linked = sheets.find_linked(frame(rows)).cache()
    assert sorted(sheets.find_tables(frame(rows)).collect()) == sorted(linked.collect())
    assert sorted(sheets.best_tolerance(frame(rows)).collect()) == sorted(sheets.choose_tolerance(linked, frame(rows)).collect())
    moved = linked.select(*[F.col(c) + F.when((F.col("sheet_id") % 4 == 0) & F.lit("row" in c), 5000).when((F.col("sheet_id") % 4 == 0) & F.lit(c == "table_id"), 5000 * sheets.NODE_WIDTH).otherwise(0) for c in linked.columns])
    assert sorted(map(tuple, sheets.find_tables(frame(wide)).collect())) == sorted(map(tuple, moved.collect()))
    for found in (sheets.find_tables(frame(rows)), sheets.best_tolerance(frame(rows))):
        assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    few = frame({(1, 0, 0), (1, 0, 1), (1, 3, 0)})
    assert sorted(tuple(r)[2:] for r in sheets.find_tables(few, (1,)).collect()) == [(0, 0, 0, 0, 1, 2), (3 * sheets.NODE_WIDTH, 3, 3, 0, 0, 1)]
