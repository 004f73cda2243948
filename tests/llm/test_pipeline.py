"""The pipeline beside a plain version of its stages on the smallest documents."""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
from docloom.llm import bpe, toxicity  # noqa: E402
from docloom.llm.common import stage, table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows) of the documents and of each stage's result."""
    docs = table(spark, FOLDER, "documents")
    out = [("documents", docs.collect())]
    for name, work in corpus_pipeline.STAGES:
        docs = stage(work(spark, docs, FOLDER), name)
        out.append((name, docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == table(spark, FOLDER, "documents").columns
    return out


def test_stages_are_the_named_ones(stages):
    assert [n for n, _ in stages] == ["documents", "toxicity", "exact_dedup", "simhash_near_dedup", "source_mix", "bpe"]


def test_toxicity_rejects_what_the_machine_rejects(spark, stages):
    machine = toxicity.fit(table(spark, FOLDER, "documents"), toxicity.learnable(table(spark, FOLDER, "labels")))
    known = toxicity.WordTerms(machine.terms)
    want = [r.doc_id for r in stages[0][1] if machine.score(toxicity.present_terms(known, r.text)) < 0.5]
    assert sorted(r.doc_id for r in stages[1][1]) == sorted(want)
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{FOLDER}/labels.parquet'").fetchall())
    lost = {r.doc_id for r in stages[0][1]} - set(want)
    assert not any(labels.get(i) == 0 for i in lost)


def test_exact_dedup_keeps_the_longest(stages):
    groups = cases.dedup([(r.doc_id, r.text) for r in stages[1][1]])
    assert sorted(r.doc_id for r in stages[2][1]) == sorted(i for i, _ in groups.values())


def test_near_dedup_keeps_one_of_each_group(stages):
    """Groups by five-word shingles and a similarity of 0.8, all pairs compared."""
    rows = sorted(stages[2][1], key=lambda r: r.doc_id)
    root = cases.similar_groups([(r.text or "").encode() for r in rows], 5, 0.8)
    assert sorted(r.doc_id for r in stages[3][1]) == [rows[i].doc_id for i in sorted(set(root))] and len(set(root)) < len(rows)


def test_mix_meets_the_targets(stages):
    before, after = stages[3][1], stages[4][1]
    size = {r.doc_id: len(cases.WORD.findall(r.text or "")) for r in before}
    sources = sorted({r.source for r in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r.doc_id] for r in before if r.source == s) for s in sources]
    got = Counter()
    for r in after:
        got[r.source] += size[r.doc_id]
    longest = {s: max(size[r.doc_id] for r in before if r.source == s) for s in sources}
    for s, target in zip(sources, cases.targets(sizes), strict=True):
        assert abs(got[s] - target) <= longest[s]  # whole rows: half a row at either end of the last pass
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_tokens_of_every_row(stages):
    vocab = bpe.Vocabulary(bpe.public_path())
    want = Counter()
    for r in stages[4][1]:
        ids = vocab.encode(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(vocab.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5][1]) == want


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert {"pipeline", "op1_license_scan", "op10_nearest_neighbours"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
