"""Sparse and multi-vector search in blocks against plain sums."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.operators import nearest  # noqa: E402


def sparse(rng, n, indices, most=6):
    return {i: {rng.randrange(indices): rng.choice([0.5, 1.0, -1.0, 2.25]) for _ in range(rng.randint(0, most))} for i in range(n)}


def best(scores, k):
    return {q: sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k] for q, found in scores.items()}


@pytest.mark.parametrize("indices, q_block, v_block", [(4, 3, 5), (1000, 4, 1000), (30, 1000, 7)])
def test_sparse_topk(spark, indices, q_block, v_block):
    rng = random.Random(indices)
    questions, items = sparse(rng, 12, indices), sparse(rng, 40, indices, 30)
    table = lambda rows, name: spark.createDataFrame([(i, j, x) for i, r in rows.items() for j, x in r.items()] + [(99, None, 1.0), (98, 1, None)], f"{name} long, index int, value double")
    got = nearest.sparse_topk(table(questions, "query_id"), table(items, "id"), "id", 5, q_block=q_block, v_block=v_block).collect()
    scores = {q: {i: sum(x * b[j] for j, x in a.items() if j in b) for i, b in items.items() if set(a) & set(b)} for q, a in questions.items()}
    assert {q: [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in questions} == {q: [(i, round(x, 6)) for i, x in r] for q, r in best(scores, 5).items()}


@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_sparse_scores_both_ways(monkeypatch, cells):
    monkeypatch.setattr(nearest, "DENSE_CELLS", cells)
    rng = random.Random(cells)
    for indices in (3, 50):
        q, v = ({i: r for i, r in sparse(rng, n, indices, 9).items() if r} for n in (9, 20))
        rows = lambda t: nearest.SparseRows(pd.Series([list(r) for r in t.values()]), pd.Series([list(r.values()) for r in t.values()]))
        score = nearest._sparse_scores(rows(q), rows(v))
        want = np.array([[sum(x * b[j] for j, x in a.items() if j in b) if set(a) & set(b) else -np.inf for b in v.values()] for a in q.values()])
        got = np.concatenate([score(0, 4), score(4, len(q))])
        both = np.isinf(got) == np.isinf(want)
        assert both.all() and np.allclose(got[np.isfinite(want)], want[np.isfinite(want)])


@pytest.mark.parametrize("q_block, v_block", [(2, 3), (100, 100)])
def test_maxsim_topk(spark, q_block, v_block):
    rng = np.random.default_rng(q_block)
    made = lambda n: {i: rng.normal(size=(int(rng.integers(0, 5)), 4)).round(3) for i in range(n)}
    questions, items = made(7), made(15)
    table = lambda rows, name: spark.createDataFrame([(i, m.tolist()) for i, m in rows.items()] + [(99, None)], f"{name} long, vectors array<array<double>>")
    got = nearest.maxsim_topk(table(questions, "query_id"), table(items, "id"), "id", 4, q_block=q_block, v_block=v_block).collect()
    scores = {q: {i: float((a @ b.T).max(axis=1).sum()) for i, b in items.items() if len(b)} for q, a in questions.items() if len(a)}
    assert {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in scores} == {q: [i for i, _ in r] for q, r in best(scores, 4).items()}
    assert {r.query_id for r in got} == set(scores)


def test_steps_of_questions_keep_every_tie():
    scores = np.array([[1.0, 2.0, 2.0, 2.0], [0.0, -1.0, 3.0, 0.0]])
    row, col = nearest._best_rows(scores, np.array([9, 8, 7, 6]), 2)
    assert list(zip(row.tolist(), col.tolist())) == [(0, 3), (0, 2), (1, 2), (1, 3)]
