"""Best documents by score and by score per word, taken in one pass."""

import numpy as np
import pytest

from docloom.operators import search


@pytest.mark.parametrize("most", [500_000, 0])
def test_two_lists_are_those_of_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_WEIGHTS", most)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 12)))) for i in range(80)]
    words = search.tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w3 w9"), (3, "none"), (4, None)], "query_id long, query_text string")
    length = {r.doc_id: r.length for r in words.collect()}
    every = [(r.query_id, r.doc_id, r.score) for r in search.bm25(asked, words, "doc_id").collect()]
    for got, score in zip(search.two_topk(asked, words, "doc_id", 4), (lambda d, s: s, lambda d, s: np.floor(s / length[d] * 1e6 + 0.5) / 1e6), strict=True):
        due = {}
        for q, d, s in every:
            due.setdefault(q, []).append((-score(d, s), d))
        due = [(q, d, -s, n) for q, x in due.items() for n, (s, d) in enumerate(sorted(x)[:4], 1)]
        assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == sorted(due) and due


def test_a_task_hands_on_at_most_two_lists():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "words": [["a"] * (1 + i % 7) for i in range(500)]})
    out = list(search.RowScorer([(7, "a", 1, 1.0)], 3.0, "or", 5, per_word=True)(iter([batch, batch.slice(3)])))
    assert sum(b.num_rows for b in out) == 10
