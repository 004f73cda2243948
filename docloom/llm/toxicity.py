"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fields, fresh, id_remainder, map_batches, stage, table

#: Terms are hashed to this many slots; the machine learns the factors of the most telling ones.
SLOT_BITS = 20
MOST_TERMS = 4096
#: A slot is telling if its share among toxic and other texts differs by this many standard errors.
LEAST_Z = 7.0
#: The most labelled rows that the model is fitted on, and the prefixes of a word that are terms beside it.
MOST_ROWS = 20_000
PREFIXES = (4, 5)
FACTORS = 4
STEPS = 400
KNOWN_WORDS = 300_000

#: Bytes of words: letters, digits and everything from U+0080 on; the rest separates.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words of a whole text in lower case."""
    return set((text or "").lower().encode("utf-8", "replace").translate(WORD_BYTES).split())


def terms_of(word: bytes) -> list[int]:
    """Slots of a word and of its prefixes (in characters)."""
    plain = word.decode("utf-8", "replace")
    found = [b"w" + word, *(b"p" + plain[:n].encode() for n in PREFIXES if len(plain) >= n)]
    return [xxhash.xxh32_intdigest(x) & ((1 << SLOT_BITS) - 1) for x in found]


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of <factors, factors>) over the terms present."""

    bias: float
    terms: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def score(self, present: list[int]) -> float:
        if not present:
            return float(1 / (1 + np.exp(-self.bias)))
        total = self.factors[present].sum(axis=0)
        pairs = 0.5 * float((total**2 - (self.factors[present] ** 2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[present].sum()) + pairs, -40, 40))))


class WordTerms(dict):
    """Numbers of a word's telling terms; forgets everything when it has met too many words."""

    def __init__(self, terms: dict[int, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        got = self[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return got


def present_terms(known: WordTerms, text: str | None) -> list[int]:
    found = set()
    for got in filter(None, map(known.__getitem__, words_of(text))):
        found.update(got)
    return sorted(found)


def train(rows: list[list[int]], labels: list[int], terms: list[int], factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """Fit the machine by full-batch adaptive gradient steps on the logistic loss; bounded by the caller's sample."""
    n, width = len(labels), len(terms)
    y = np.array(labels, dtype=np.float64)
    share = (y.sum() + 0.01) / (n + 1.0) if n else 0.001
    share = min(max(share, 1e-4), 0.45)
    bias, weights = float(np.log(share / (1 - share))), np.zeros(width)
    v = np.random.default_rng(7).normal(0, 0.02, (width, factors))
    number = {t: i for i, t in enumerate(terms)}
    if not width or y.min(initial=1) == y.max(initial=0):
        return Machine(bias, number, weights, v)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    term = np.array([t for r in rows for t in r], dtype=np.int64)
    sums = lambda values, places, size: np.bincount(places, values, size)
    gb, gw, gv = 1e-6, np.full(width, 1e-6), np.full((width, factors), 1e-6)
    for _ in range(steps):
        total = np.stack([sums(v[term, f], at, n) for f in range(factors)], axis=1)
        square = sum(sums(v[term, f] ** 2, at, n) for f in range(factors))
        z = bias + sums(weights[term], at, n) + 0.5 * ((total**2).sum(axis=1) - square)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        db, dw = error.sum(), sums(error[at], term, width) + 1e-6 * weights
        dv = np.stack([sums(error[at] * (total[at, f] - v[term, f]), term, width) for f in range(factors)], axis=1) + 1e-5 * v
        gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
        bias -= 0.3 * db / np.sqrt(gb)
        weights -= 0.3 * dw / np.sqrt(gw)
        v -= 0.03 * dv / np.sqrt(gv)
    return Machine(bias, number, weights, v)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most_rows: int = MOST_ROWS) -> Machine:
    """Fit on at most ``most_rows`` labelled rows of ``docs``, those with the smallest hashes of their ids.

    ``labels`` holds the ids and labels that may be learned from; null labels are left out and a
    repeated id counts as toxic if one of its labels says so. Terms are screened by how their
    share differs between the classes. Without both classes, every score is the bias.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    held = docs.select(F.col(doc_id).alias("id")).distinct()
    chosen = chosen.join(held, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most_rows)
    sample = stage(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("y", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << SLOT_BITS), dtype=np.int64)
        for batch in batches:
            for y, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(y > 0), sorted({t for w in words_of(value) for t in terms_of(w)})] += 1
        slot = np.nonzero(seen.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(seen[0, slot]), pa.array(seen[1, slot])], names=["slot", "clean", "toxic"])

    n0, n1 = sample.agg(F.count_if(F.col("y") <= 0), F.count_if(F.col("y") > 0)).first()
    terms: list[int] = []
    if n0 and n1:
        found = map_batches(sample, count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
        pooled = (F.col("c") + F.col("t")) / (n0 + n1)
        z = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
        telling = found.where((pooled < 1) & (F.abs(z) >= LEAST_Z)).orderBy(F.abs(z).desc(), "slot").limit(MOST_TERMS)
        terms = sorted(r["slot"] for r in telling.collect())
    number = {t: i for i, t in enumerate(terms)}

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTerms(number)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([present_terms(known, t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["y", "terms"])

    rows = sorted((int(r["y"] > 0), list(r["terms"])) for r in map_batches(sample, shown, "y int, terms array<int>").collect())
    return train([r[1] for r in rows], [r[0] for r in rows], terms)


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score of 0 to 1 for each whole text; null, empty and unknown texts get the bias.

    Only the text is an input. Repeated rows repeat their score; an empty table stays empty. The
    added column gets a name that clashes with none and comes back as the second value.
    """
    name, at = fresh(docs.columns, "score"), docs.columns.index(text)
    schema = fields(docs.schema, (name, T.DoubleType()))
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTerms(machine.terms)
        for batch in batches:
            found = [machine.score(present_terms(known, value.as_py())) for value in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=names)

    return map_batches(docs, work, schema), name


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; same columns."""
    rows, name = scored(docs, fit(docs, labels, text, doc_id), text)
    return rows.where(F.col(name) < 0.5).select(*docs.columns)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id modulo 5 is not 0."""
    return labels.where(id_remainder("doc_id", 5) != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, learnable(table(spark, sf_dir, "labels")))
    rows, name = scored(docs, machine)
    return rows.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
