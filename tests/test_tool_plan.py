"""Plans of tools on a handful of questions."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.operators import tool_plan  # noqa: E402

PLAN = "query_id long, step int, tool string, " + ", ".join(f"{n} {t}" for n, t in tool_plan.PARAMETERS.items())


def step(query_id, n, tool, **p):
    return (query_id, n, tool, *(p.get(c) for c in tool_plan.PARAMETERS))


@pytest.fixture(scope="module")
def tools(spark):
    chunks = spark.createDataFrame(
        [(1, "GB 1", "1.1", "cables and fire", 1), (2, "GB 1", "1.2", "fire doors", 2), (3, "GB 2", "1.1", "water", 1), (4, "GB 3", "2.1", "fire, water and cables", None), (5, "GB 1", "1.1", "twin", 9)],
        "chunk_id long, standard_no string, clause string, content string, position int",
    )
    documents = spark.createDataFrame([(1, "GB 1", "Fire safety", "A", "completed"), (2, "GB 2", "Water", "A", "completed"), (3, "GB 3", "Fire and water", "B", "completed"), (4, "GB 4", "Fire", "A", "pending")], "doc_id long, standard_no string, title string, category string, process_status string")
    tables = spark.createDataFrame([(10, 4, "Rating", "A2", "GB 3"), (11, None, "Other", "A2.1", "GB 1"), (12, 2, "Plain", "B1", "GB 1")], "table_id long, chunk_id long, title string, table_number string, standard_no string")
    return tool_plan.standard_tools(chunks, documents, tables, ["title"])


def run(spark, tools, *steps, **more):
    hits, trace = tool_plan.run_plan(spark.createDataFrame(list(steps), PLAN), tools, **more)
    found: dict = {}
    for r in hits.orderBy("query_id", "step", "rank").collect():
        found.setdefault((r.query_id, r.step), []).append((r.chunk_id, r.score))
    return found, sorted((r.query_id, r.step, r.tool, r.results) for r in trace.collect())


def test_steps_use_what_was_found_and_stop(spark, tools):
    found, trace = run(
        spark, tools,
        step(1, 1, "list_related_standards", keyword="Fire"), step(1, 2, "retrieve_standard", query="fire cables", use_found=True), step(1, 3, "retrieve_clause", standard_id="GB 1", clause="1.1"),
        step(2, 1, "list_related_standards", keyword="Fire", category="B"), step(2, 2, "retrieve_standard", query="fire", use_found=True), step(2, 3, "sufficient"),
        step(3, 1, "retrieve_clause", standard_id="GB 9", clause="1.1"), step(3, 2, "retrieve_standard", query="water", standards=["GB 2", "GB 2"]),
        step(4, 1, "sufficient"), step(4, 2, "retrieve_clause", standard_id="GB 1", clause="1.1"), step(5, 2, "retrieve_clause", standard_id="GB 1", clause="1.1"), step(6, 1, "nonsense"),
    )
    assert found == {(1, 2): [(1, 1.0), (4, 1.0), (2, 0.5)], (1, 3): [(1, 1.0)], (2, 2): [(4, 1.0)], (3, 2): [(3, 1.0)]}
    assert trace == [
        (1, 1, "list_related_standards", 0), (1, 2, "retrieve_standard", 3), (1, 3, "retrieve_clause", 1), (2, 1, "list_related_standards", 0), (2, 2, "retrieve_standard", 1),
        (3, 1, "retrieve_clause", 0), (3, 2, "retrieve_standard", 1),
    ]


def test_tables_and_their_fallback(spark, tools):
    found, _ = run(
        spark, tools, step(1, 1, "retrieve_table", table_title="A2"), step(2, 1, "retrieve_table", table_title="A2", standard_id="GB 1"), step(3, 1, "retrieve_table", table_title="fire doors Z9", standard_id="GB 1"),
        step(4, 1, "retrieve_table", table_title="water Z9"), step(5, 1, "retrieve_table", table_title="plain", standard_id="GB 1"), steps=1,
    )
    assert found[1, 1] == [(4, 1.0), (11, 1.0)] and found[2, 1] == [(11, 1.0)] and found[5, 1] == [(11, 1.0), (2, 1.0)]
    assert [c for c, _ in found[3, 1]] == [2, 1] and {c for c, _ in found[4, 1]} == {3, 4}  # by words, in the standard and anywhere


def test_first_occurrence_counts(spark, tools):
    hits, _ = tool_plan.run_plan(spark.createDataFrame([step(1, 1, "retrieve_standard", query="fire doors", standards=["GB 1"]), step(1, 2, "retrieve_clause", standard_id="GB 1", clause="1.1")], PLAN), tools)
    assert [(r.chunk_id, r.score, r.step) for r in tool_plan.combined(hits).orderBy("rank").collect()] == [(2, 1.0, 1), (1, 0.5, 1)]


def test_no_questions(spark, tools):
    hits, trace = tool_plan.run_plan(spark.createDataFrame([], PLAN), tools)
    assert hits.count() == trace.count() == 0
