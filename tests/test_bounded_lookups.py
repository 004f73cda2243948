"""Cache lookups meet entries of their time only; documents are scored a few at a time."""

import numpy as np
import pandas as pd
import pyarrow as pa

from docloom.operators import logs, nearest, search


def test_lookups_meet_entries_of_their_time_only(spark, monkeypatch):
    rng, pairs = np.random.default_rng(8), []
    whole = nearest.similar_pairs
    monkeypatch.setattr(logs, "similar_pairs", lambda *a, **k: pairs.append(whole(*a, **k)) or pairs[-1])
    at = [int(x) for x in rng.integers(0, 1000, 60)] + [100, 110, None]
    rows = spark.createDataFrame([(i, "f" if i % 3 else "g", rng.normal(size=4).tolist(), t) for i, t in enumerate(at)], "lookup_id long, filters_hash string, vector array<double>, t long").selectExpr("lookup_id", "filters_hash", "vector", "timestamp_seconds(t) asked_at")
    entries = rows.selectExpr("lookup_id entry_id", "filters_hash", "vector", "asked_at created_at").where("entry_id % 2 = 0")
    got = {(r.lookup_id, r.entry_id, r.similarity) for r in logs.semantic_lookup(rows, entries, 0.1, 10).collect()}
    v = {r.lookup_id: (r.filters_hash, np.array(r.vector) / np.linalg.norm(r.vector)) for r in rows.collect()}
    due = set()
    for i in v:
        near = [(-round(float(v[i][1] @ v[j][1]), 6), j) for j in v if j % 2 == 0 and v[i][0] == v[j][0] and None not in (at[i], at[j]) and 0 <= at[i] - at[j] <= 10]
        due |= {(i, j, -s) for s, j in sorted(near)[:1] if -s >= 0.1}
    assert got == due and len(due) > 5
    assert pairs[0].count() < 200  # of 1,000 and more at any age


def test_documents_of_a_large_batch_are_held_a_few_at_a_time(monkeypatch):
    held = []
    scorer = search.RowScorer([(7, "a", 1, 1.0)], 3.0, "or", 5)
    best = scorer.best
    monkeypatch.setattr(scorer, "best", lambda rows: held.append(len(rows[0])) or best(rows))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "words": [["a"] * (1 + i % 7) for i in range(5000)]})
    out = pa.Table.from_batches(scorer(iter([batch]))).to_pandas()
    assert max(held) <= search.ROWS_AT_ONCE + 5
    assert isinstance(out, pd.DataFrame) and len(out) == 5
