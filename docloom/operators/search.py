"""Text search: postings, BM25, phrase search, field boosts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators.skew import best_row, top_k
from docloom.session import cut_lineage

K1, B = 1.2, 0.75
#: The most rows of question weights that are shipped to the tasks.
MOST_WEIGHTS = 500_000
#: Documents whose words and scores a task holds at a time, however large its Arrow batches are.
ROWS_AT_ONCE = 256


def tokenize(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, words, length); text without words has length 0."""
    words = F.array_remove(tokens(text), "")
    return df.select(key, words.alias("words")).withColumn("length", F.size("words").cast("long"))


def postings(words: DataFrame, key: str, only_terms: DataFrame | None = None) -> DataFrame:
    """Inverted index rows (term, key, tf, length).

    ``only_terms`` restricts the index to the terms of the questions at hand before the
    aggregation shuffle; Spark broadcasts that side when it is small enough.
    """
    exploded = words.select(key, "length", F.explode("words").alias("term"))
    if only_terms is not None:
        exploded = exploded.join(only_terms.select("term").distinct(), "term", "left_semi")
    return exploded.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(index: DataFrame) -> DataFrame:
    """Document and collection frequency per term."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def query_terms(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Rows (query_id, term, qtf, n_terms)."""
    words = queries.select("query_id", F.array_remove(tokens(text), "").alias("w"))
    exploded = words.select("query_id", F.size(F.array_distinct("w")).alias("n_terms"), F.explode("w").alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.first("n_terms").alias("n_terms"))


def term_weights(wanted: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Rows (query_id, term, n_terms, weight): idf times frequency of each word of each question."""
    terms = wanted.select("term").distinct()
    held = words.select(F.explode(F.array_distinct("words")).alias("term")).join(terms, "term", "left_semi")
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    return wanted.join(frequency, "term").select("query_id", "term", "n_terms", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("weight"))


def bm25(queries: DataFrame, words: DataFrame, key: str, operator: str = "or", k: int | None = None) -> DataFrame:
    """BM25 rows (query_id, key, score, matched) for every document sharing a term, or the best ``k`` per question.

    With ``operator='and'`` all distinct question terms must occur. All words of a document lie
    in its row, so a first pass counts documents per question term and a second scores each row
    where it is; with ``k`` a task hands on at most k rows per question. The questions' weights are
    shipped when they are checked to be few; more of them are joined term by term.
    """
    stats = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    weights = term_weights(query_terms(queries), words, stats["n"])
    whole_keys = all(dict(df.dtypes)[c] in ("bigint", "int") for df, c in ((words, key), (queries, "query_id")))
    shipped = weights.limit(MOST_WEIGHTS + 1).collect() if whole_keys else []
    if len(shipped) > MOST_WEIGHTS or not whole_keys:
        scored = _bm25_by_join(weights, words, key, operator, stats["mean"])
    else:
        scorer = RowScorer([(r["query_id"], r["term"], r["n_terms"], r["weight"]) for r in shipped], stats["mean"] or 0.0, operator, k)
        scored = words.select(key, "words").mapInArrow(scorer, f"query_id {dict(queries.dtypes)['query_id']}, `{key}` {dict(words.dtypes)[key]}, score double, matched long")
    return scored if k is None else top_k(scored, ["query_id"], [F.desc("score"), F.asc(key)], k)


def _bm25_by_join(weights: DataFrame, words: DataFrame, key: str, operator: str, mean: float, more: Sequence[str] = ()) -> DataFrame:
    """The same rows for more questions than can be shipped: one posting per word and document meets the weights."""
    hits = postings(words, key, weights).join(weights, "term")
    part = F.col("weight") * saturation(F.col("tf"), F.col("length"), F.lit(mean))
    scored = hits.groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms"), *[F.first(c).alias(c) for c in more])
    if operator == "and":
        scored = scored.where(F.col("matched") == F.col("n_terms"))
    return scored.select("query_id", key, F.round("score", 6).alias("score"), "matched", *more)


class RowScorer:
    """Scores documents row by row against shipped question weights; a task keeps its best rows per question.

    With ``per_word`` the rows say which list they are of: the best by score, or the best by score per word.
    """

    def __init__(self, weights: list[tuple], mean: float, operator: str, k: int | None, per_word: bool = False):
        self.mean, self.operator, self.k, self.per_word = mean, operator, k, per_word
        self.ids = np.array(sorted({w[0] for w in weights}), dtype=np.int64)
        number = {q: i for i, q in enumerate(self.ids.tolist())}
        self.n_terms = np.zeros(len(self.ids), dtype=np.int64)
        by_term: dict[str, list[tuple[int, float]]] = {}
        for query, term, n_terms, weight in weights:
            by_term.setdefault(term, []).append((number[query], weight))
            self.n_terms[number[query]] = n_terms
        self.terms = {t: (np.array([q for q, _ in x]), np.array([w for _, w in x])) for t, x in by_term.items()}

    def row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of matched terms of each question for one document."""
        length, tf = len(words), Counter(w for w in words if w in self.terms)
        if not tf:
            none = np.zeros(len(self.ids))
            return none, none
        norm = K1 * (1 - B + B * length / self.mean)
        found = [self.terms[t] for t in tf]
        places = np.concatenate([q for q, _ in found])
        parts = np.concatenate([w * (n * (K1 + 1) / (n + norm)) for (_, w), n in zip(found, tf.values(), strict=True)])
        return np.bincount(places, parts, len(self.ids)), np.bincount(places, minlength=len(self.ids))

    def best(self, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The k best of (question, key, score, matched) rows per question, ties to the smaller key."""
        query, key, score, _ = rows
        by = np.lexsort((key, -score, query))
        first = np.searchsorted(query[by], query[by])
        by = by[np.arange(len(by)) - first < self.k]
        return tuple(x[by] for x in rows)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = [None] * (1 + self.per_word), None
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            names = ["query_id", batch.schema.names[0], "score", "matched"]
            keys, out, lengths = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for key, words in zip(keys.tolist(), batch.column(1).to_pylist(), strict=True):
                score, matched = self.row(words or [])
                at = np.nonzero(matched == self.n_terms if self.operator == "and" else matched)[0]
                if len(at):
                    out.append((at, np.full(len(at), key, dtype=np.int64), np.round(score[at], 6), matched[at].astype(np.int64)))
                    lengths.append(np.full(len(at), len(words)))
            if not out:
                continue
            rows = tuple(map(np.concatenate, zip(*out, strict=True)))
            if self.k is None:
                yield self._batch(rows, names)
                continue
            lists = [rows]
            if self.per_word:
                # Rounded as the SQL does it: a half of the scaled number goes up.
                lists.append((*rows[:2], np.floor(rows[2] / np.concatenate(lengths) * 1e6 + 0.5) / 1e6, rows[3]))
            held = [self.best(new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))) for old, new in zip(held, lists, strict=True)]
        for number, rows in enumerate(held):
            if rows is not None:
                yield self._batch(rows, names, number if self.per_word else None)

    def _batch(self, rows: tuple[np.ndarray, ...], names: list[str], number: int | None = None) -> pa.RecordBatch:
        columns, more = [pa.array(self.ids[rows[0]]), *(pa.array(x) for x in rows[1:])], []
        if number is not None:
            columns, more = [*columns, pa.array(np.full(len(rows[0]), number, dtype=np.int32))], ["list"]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *more])


def two_topk(queries: DataFrame, words: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` per question by BM25, and the best ``k`` by BM25 per word of the document: rows (query_id, key, score, matched, rank).

    Both are taken in one pass over the documents and written once, so a task hands on at
    most 2 k rows per question.
    """
    stats = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    weights = term_weights(query_terms(queries), words, stats["n"])
    whole_keys = all(dict(df.dtypes)[c] in ("bigint", "int") for df, c in ((words, key), (queries, "query_id")))
    shipped = weights.limit(MOST_WEIGHTS + 1).collect() if whole_keys else []
    if len(shipped) > MOST_WEIGHTS or not whole_keys:
        scored = _bm25_by_join(weights, words, key, "or", stats["mean"], ["length"])
        per_word = F.floor(F.col("score") / F.col("length") * 1e6 + 0.5) / 1e6
        both = scored.withColumn("list", F.lit(0)).unionByName(scored.withColumn("score", per_word).withColumn("list", F.lit(1))).drop("length")
    else:
        scorer = RowScorer([(r["query_id"], r["term"], r["n_terms"], r["weight"]) for r in shipped], stats["mean"] or 0.0, "or", k, per_word=True)
        both = words.select(key, "words").mapInArrow(scorer, f"query_id {dict(queries.dtypes)['query_id']}, `{key}` {dict(words.dtypes)[key]}, score double, matched long, list int")
    best = cut_lineage(top_k(both, ["list", "query_id"], [F.desc("score"), F.asc(key)], k))
    return tuple(best.where(F.col("list") == n).drop("list") for n in (0, 1))


def keyword_topk(queries: DataFrame, words: DataFrame, key: str, k: int = 20, operator: str = "or") -> DataFrame:
    return bm25(queries, words, key, operator, k)


def holding_any(queries: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Keys of the documents that share a word with any question."""
    terms = query_terms(queries).select("term").distinct()
    return words.select(key, F.explode(F.array_distinct("words")).alias("term")).join(terms, "term", "left_semi").select(key).distinct()


def exact_field(queries: DataFrame, df: DataFrame, key: str, field: str, text: str = "query_text") -> DataFrame:
    """Score of an unanalysed field: its idf where the whole question equals the value."""
    values = df.select(key, F.col(field).alias("value")).where(F.col("value").isNotNull())
    total = values.agg(F.count("*").alias("n")).scalar()
    counts = values.groupBy("value").agg(F.count("*").alias("df"))
    wanted = queries.select("query_id", F.col(text).alias("value"))
    rated = wanted.join(counts, "value").select("query_id", "value", idf(total, F.col("df")).alias("score"))
    return values.join(rated, "value").select("query_id", key, F.round("score", 6).alias("score"))


def best_fields(scores: Mapping[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """Best boosted field score per document; ``scores`` maps a field to (scores, boost)."""
    united = None
    for field, (df, boost) in scores.items():
        rows = df.select("query_id", key, (F.col("score") * boost).alias("score"), F.lit(field).alias("field"))
        united = rows if united is None else united.unionByName(rows)
    return united.groupBy("query_id", key).agg(
        F.round(F.max("score"), 6).alias("score"), F.max_by("field", "score").alias("field")
    )


def phrase_matches(queries: DataFrame, words: DataFrame, key: str, text: str = "query_text") -> DataFrame:
    """Rows (query_id, key, occurrences) of documents holding the words in sequence.

    Only documents holding the rarest word of the phrase are expanded to positions.
    """
    asked = queries.select("query_id", F.array_remove(tokens(text), "").alias("w"))
    asked = asked.select("query_id", F.size("w").alias("n"), F.posexplode("w").alias("offset", "term"))
    placed = words.select(key, F.posexplode("words").alias("pos", "term"))
    placed = placed.join(asked.select("term").distinct(), "term", "left_semi")
    frequency = placed.groupBy("term").agg(F.count("*").alias("cf"))
    rarest = best_row(asked.join(frequency, "term", "left"), ["query_id"], [F.coalesce("cf", F.lit(0)).asc(), F.asc("offset")])
    starts = placed.join(rarest.select("query_id", "term", "offset", "n"), "term").select(
        "query_id", key, "n", (F.col("pos") - F.col("offset")).alias("start")
    )
    # Expand each candidate start to the positions the phrase needs, then look them up.
    needed = starts.join(asked.select("query_id", "offset", "term"), "query_id").withColumn("pos", F.col("start") + F.col("offset"))
    found = needed.join(placed, [key, "term", "pos"], "left_semi")
    full = found.groupBy("query_id", key, "start").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") == F.col("n"))
    return full.groupBy("query_id", key).agg(F.count("*").alias("occurrences"))


def standard_series(number: Column) -> Column:
    upper = F.upper(number)
    return (
        F.when(upper.startswith("GB"), "GB").when(upper.startswith("DL"), "DL").when(upper.startswith("NB"), "NB").otherwise("其他")
    )


def count_by_value(df: DataFrame, field: str, n: int = 10, hits: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Most frequent values of a field, over all rows or only over search hits."""
    rows = df if hits is None else df.join(hits.select(key).distinct(), key, "left_semi")
    counted = rows.where(F.coalesce(F.col(field), F.lit("")) != "").groupBy(field).agg(F.count("*").alias("doc_count"))
    return counted.orderBy(F.desc("doc_count"), F.asc(field)).limit(n)
