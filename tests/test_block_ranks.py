"""Best entries of a block of scores, and multi-vectors of several lengths."""

import numpy as np
import pandas as pd
import pytest

from docloom.operators import nearest


@pytest.mark.parametrize("odd", [None, np.nan, -np.inf])
def test_rounding_and_ties_are_those_of_whole_rounded_rows(odd):
    rng = np.random.default_rng(6)
    scores = np.round(rng.normal(size=(20, 60)), 2) + rng.integers(-4, 5, (20, 60)) * 1e-7
    if odd is not None:
        scores[3, :50] = odd
    ids = rng.permutation(60)
    row, col = nearest._best_rows(np.round(scores, 6), ids, 15)
    got = nearest._best_rounded(scores.copy(), ids, 15, 6)
    assert np.array_equal(got[0], row) and np.array_equal(got[1], col) and np.array_equal(got[2], np.round(scores, 6)[row, col], equal_nan=True)


@pytest.mark.parametrize("lengths", [(4, 5), (1, 5), (1, 40)])
def test_maxsim_of_items_with_several_numbers_of_vectors(spark, lengths):
    rng = np.random.default_rng(7)
    many = [(i, rng.normal(size=(40 if i == 3 and lengths[1] == 40 else rng.integers(lengths[0], min(lengths[1], 5)), 3)).tolist()) for i in range(30)]
    rows = spark.createDataFrame(many, "vec_id long, vectors array<array<double>>")
    got = nearest.maxsim_topk(rows.withColumnRenamed("vec_id", "query_id"), rows, "vec_id", 6, q_block=7, v_block=9).collect()
    m = {i: np.array(v) for i, v in many}
    due = []
    for q in m:
        best = sorted((-round(float((m[q] @ m[v].T).max(axis=1).sum()), 6), v) for v in m)[:6]
        due += [(q, v, -s, n) for n, (s, v) in enumerate(best, 1)]
    assert pd.DataFrame(sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got)).equals(pd.DataFrame(sorted(due)))
