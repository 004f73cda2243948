"""Vector joins by matrix products in Arrow batches.

Two ways, chosen by a checked size. A small question side is shipped to every task and
each task keeps its own top k, so vectors are scanned once and never shuffled. A larger
one is cut into blocks and each (question block, vector block) pair becomes one bounded
group. Both give the same exact result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.skew import top_k

MAX_SHIPPED_QUERIES = 4096
#: Questions and items of one group, scores held at a time, cells of a block multiplied as a matrix.
QUESTION_BLOCK, ITEM_BLOCK = 4096, 16_384
SCORE_CELLS = 1 << 22
DENSE_CELLS = 1 << 24


def _matrix(column: pd.Series) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _unit(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1.0)


def _best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best entries of each row, ties by id."""
    if scores.shape[1] > k:
        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(scores >= bar)
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def _best_rounded(scores: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best rounded entries of each row, ties by id.

    What lies a whole last digit below the k-th best can't reach it by rounding, so only the rest is rounded and sorted.
    """
    n = scores.shape[1]
    bar = np.partition(scores, n - k, axis=1)[:, n - k] - 10.0**-digits if n > k else np.full(len(scores), np.nan)
    if not np.isfinite(bar).all():
        scores = np.round(scores, digits)
        row, col = _best_rows(scores, ids, k)
        return row, col, scores[row, col]
    row, col = np.nonzero(scores >= bar[:, None])
    best = np.round(scores[row, col], digits)
    order = np.lexsort((ids[col], -best, row))
    row, col, best = row[order], col[order], best[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(scores)))[row] < k
    return row[keep], col[keep], best[keep]


def _rank_block(qid: np.ndarray, ids: np.ndarray, k: int, digits: int, score: Callable[[int, int], np.ndarray], width: int | None = None) -> list[pd.DataFrame]:
    """Top k of one item block for each question; ``score(a, b)`` gives the rows of questions a to b.

    Questions go in steps of at most ``SCORE_CELLS`` scores, so the block's matrix is never whole.
    """
    parts, step = [], max(1, SCORE_CELLS // max(width or len(ids), 1))
    for at in range(0, len(qid), step):
        row, col, best = _best_rounded(score(at, min(at + step, len(qid))), ids, k, digits)
        parts.append(pd.DataFrame({"query_id": qid[at + row], "key": ids[col], "score": best}))
    return parts


def _by_blocks(q: DataFrame, v: DataFrame, k: int, rank: Callable[[pd.DataFrame, pd.DataFrame], list[pd.DataFrame]], schema: T.StructType, q_block: int = QUESTION_BLOCK, v_block: int = ITEM_BLOCK) -> DataFrame:
    """Best k of each (question block, item block) pair, every pair one bounded group.

    Items are written once per question block, questions once per item block. Nothing passes the driver
    but the two counts; a crowded block cannot be, as rows are dealt by the hash of their id.
    """
    q_blocks, v_blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((q, q_block), (v, v_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = v.withColumn("_vb", F.pmod(F.xxhash64("key"), F.lit(v_blocks))).withColumn("_qb", every(q_blocks))
    right = q.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("_vb", every(v_blocks))
    empty = pd.DataFrame({c: np.array([], object) for c in ("query_id", "key", "score")})

    def pair(vp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(rank(qp, vp), ignore_index=True) if len(vp) and len(qp) else empty

    return left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInPandas(pair, schema)


def _result(q: DataFrame, v: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("key", v.schema["key"].dataType), T.StructField("score", T.DoubleType())])


def dense_topk(
    queries: DataFrame,
    vectors: DataFrame,
    key: str,
    k: int = 20,
    metric: str = "cosine",
    query_vector: str = "vector",
    vector: str = "vector",
    max_shipped: int = MAX_SHIPPED_QUERIES,
    digits: int = 6,
) -> DataFrame:
    """Exact nearest vectors per question: rows (query_id, key, score, rank).

    Filter ``vectors`` first, so that a filtered question can still fill its k places.
    """
    unit = metric == "cosine"
    q = queries.select("query_id", F.col(query_vector).alias("qv"))
    v = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vv"))
    schema = _result(q, v)

    if q.limit(max_shipped + 1).count() <= max_shipped:
        shipped = q.toPandas()
        qm = _matrix(shipped["qv"])
        box = q.sparkSession.sparkContext.broadcast((shipped["query_id"].to_numpy(), _unit(qm) if unit else qm))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, matrix = box.value
            held: pd.DataFrame | None = None
            for batch in batches:
                if len(batch) == 0 or len(qid) == 0:
                    continue
                vm = _matrix(batch["vv"])
                vm = _unit(vm) if unit else vm
                rows = _rank_block(qid, batch["key"].to_numpy(), k, digits, lambda a, b, vm=vm: matrix[a:b] @ vm.T)
                merged = pd.concat(rows if held is None else [held, *rows], ignore_index=True)
                merged = merged.sort_values(["query_id", "score", "key"], ascending=[True, False, True])
                held = merged.groupby("query_id", sort=False).head(k)
            if held is not None:
                yield held

        partial = v.mapInPandas(scan, schema)
    else:

        def rank(qp: pd.DataFrame, vp: pd.DataFrame) -> list[pd.DataFrame]:
            vm, qm = (_unit(_matrix(p)) if unit else _matrix(p) for p in (vp["vv"], qp["qv"]))
            return _rank_block(qp["query_id"].to_numpy(), vp["key"].to_numpy(), k, digits, lambda a, b: qm[a:b] @ vm.T)

        partial = _by_blocks(q, v, k, rank, schema)

    ranked = top_k(partial, ["query_id"], [F.desc("score"), F.asc("key")], k)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_id: str,
    right_id: str,
    threshold: float,
    vector: str = "vector",
    block: int = 4096,
    digits: int = 6,
) -> DataFrame:
    """Pairs with equal ``on`` columns and cosine at or above the threshold.

    Each key is cut into row blocks on both sides, so a hot key is shared by many tasks
    and a task never holds more than two blocks and ``SCORE_CELLS`` scores; only passing pairs leave the task.
    """
    def blocks(df: DataFrame) -> int:
        largest = df.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
        return max(1, math.ceil(largest / block))

    n_left, n_right = blocks(left), blocks(right)
    l = left.select(*on, F.col(left_id).alias("l_id"), F.col(vector).alias("lv")).withColumn(
        "_lb", F.pmod(F.xxhash64("l_id"), F.lit(n_left))
    ).withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))))
    r = right.select(*on, F.col(right_id).alias("r_id"), F.col(vector).alias("rv")).withColumn(
        "_rb", F.pmod(F.xxhash64("r_id"), F.lit(n_right))
    ).withColumn("_lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))))
    schema = T.StructType([
        *[l.schema[c] for c in on],
        T.StructField(left_id, l.schema["l_id"].dataType),
        T.StructField(right_id, r.schema["r_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    on = list(on)

    def pair(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({f.name: np.array([], object) for f in schema.fields})
        if len(lp) == 0 or len(rp) == 0:
            return nothing
        lm, rm, step, found = _unit(_matrix(lp["lv"])), _unit(_matrix(rp["rv"])).T, max(1, SCORE_CELLS // len(rp)), []
        for at in range(0, len(lp), step):
            scores = np.round(lm[at : at + step] @ rm, digits)
            i, j = np.nonzero(scores >= threshold)
            found.append((i + at, j, scores[i, j]))
        i, j, similarity = map(np.concatenate, zip(*found))
        if not len(i):
            return nothing
        out = {c: np.repeat(lp[c].iloc[0], len(i)) for c in on}
        out[left_id], out[right_id] = lp["l_id"].to_numpy()[i], rp["r_id"].to_numpy()[j]
        out["similarity"] = similarity
        return pd.DataFrame(out)

    keys = [*on, "_lb", "_rb"]
    return l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(pair, schema)


def maxsim_topk(
    queries: DataFrame, items: DataFrame, key: str, k: int = 50, query_vectors: str = "vectors", vectors: str = "vectors", digits: int = 6, q_block: int = QUESTION_BLOCK, v_block: int = ITEM_BLOCK
) -> DataFrame:
    """Late interaction: sum over question vectors of the best dot product in the item.

    Question blocks meet item blocks in bounded groups. The n-th vectors of a block's items lie in one
    matrix, so the best per item is the larger of whole matrices; where numbers of vectors differ much,
    all lie in one and the best is taken over its slices. Questions and items without vectors have no score.
    """
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    q = queries.where(some(query_vectors)).select("query_id", F.col(query_vectors).alias("qv"))
    v = items.where(some(vectors)).select(F.col(key).alias("key"), F.col(vectors).alias("vv"))

    def flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        return np.array([v for m in column for v in m], np.float64), np.cumsum([0, *map(len, column)])

    def rank(qp: pd.DataFrame, vp: pd.DataFrame) -> list[pd.DataFrame]:
        (qm, q_start), (vm, v_start) = flat(qp["qv"]), flat(vp["vv"])
        q_most, v_most = int(np.diff(q_start).max()), int(np.diff(v_start).max())

        def slices(a: int, b: int) -> np.ndarray:
            best = np.maximum.reduceat(qm[q_start[a] : q_start[b]] @ vm.T, v_start[:-1], axis=1)
            return np.add.reduceat(best, q_start[a:b] - q_start[a], axis=0)

        # The n-th vectors of all items are one matrix; an item with fewer repeats its last, which changes no best.
        nth = [np.ascontiguousarray(vm[np.minimum(v_start[:-1] + n, v_start[1:] - 1)].T) for n in range(v_most)] if v_most * len(vp) <= 2 * len(vm) else []

        def nths(a: int, b: int) -> np.ndarray:
            total = np.zeros((b - a, len(vp)))
            best, other = np.empty_like(total), np.empty_like(total)
            for n in range(q_most):
                has = q_start[a:b] + n < q_start[a + 1 : b + 1]
                asked = qm[np.minimum(q_start[a:b] + n, len(qm) - 1)]
                np.matmul(asked, nth[0], out=best)
                for m in nth[1:]:
                    np.maximum(best, np.matmul(asked, m, out=other), out=best)
                best[~has] = 0.0
                total += best
            return total

        score, width = (nths, len(vp)) if nth else (slices, len(vm) * q_most)
        return _rank_block(qp["query_id"].to_numpy(), vp["key"].to_numpy(), k, digits, score, width)

    ranked = top_k(_by_blocks(q, v, k, rank, _result(q, v), q_block, v_block), ["query_id"], [F.desc("score"), F.asc("key")], k)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


class SparseRows:
    """Rows of (index, value) lists over the indices that occur in them, postings by index."""

    def __init__(self, indices: pd.Series, values: pd.Series):
        self.n = len(indices)
        lengths = np.array([len(i) for i in indices], np.int64)
        self.row = np.repeat(np.arange(self.n), lengths)
        self.index, self.value = np.concatenate([np.asarray(i) for i in indices]), np.concatenate([np.asarray(v, np.float64) for v in values])

    def on(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in ``known``, value) of the entries whose index is known."""
        at = np.minimum(np.searchsorted(known, self.index), len(known) - 1)
        hit = known[at] == self.index
        return self.row[hit], at[hit], self.value[hit]


def _sparse_scores(q: SparseRows, v: SparseRows) -> Callable[[int, int], np.ndarray]:
    """Scores of questions a to b against all items of a block; entries that are not there count nothing.

    Blocks that share few indices, or are mostly filled, are multiplied as matrices. Otherwise the
    postings of each question's indices are laid end to end and added up per (question, item), so
    only products of shared indices are formed.
    """
    known = np.intersect1d(q.index, v.index)
    nothing = lambda a, b: np.full((b - a, v.n), -np.inf)
    if not len(known):
        return nothing
    (qr, qi, qx), (vr, vi, vx) = q.on(known), v.on(known)
    if v.n * len(known) <= min(DENSE_CELLS, 8 * len(vx)) and q.n * len(known) <= DENSE_CELLS:
        qm, vm = np.zeros((q.n, len(known))), np.zeros((v.n, len(known)))
        np.add.at(qm, (qr, qi), qx)
        np.add.at(vm, (vr, vi), vx)
        qh, vh = (qm != 0).astype(np.float32), (vm != 0).astype(np.float32)
        full = bool(qh.all() or vh.all())
        return lambda a, b: (qm[a:b] @ vm.T) if full else np.where(qh[a:b] @ vh.T > 0, qm[a:b] @ vm.T, -np.inf)
    order = np.argsort(vi, kind="stable")
    vr, vx = vr[order], vx[order]
    start = np.searchsorted(vi[order], np.arange(len(known) + 1))
    first = np.searchsorted(qr, np.arange(q.n + 1))

    def score(a: int, b: int) -> np.ndarray:
        rows, at, x = (c[first[a] : first[b]] for c in (qr, qi, qx))
        n = start[at + 1] - start[at]
        place = np.repeat(start[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        cell = (np.repeat(rows, n) - a) * v.n + vr[place]
        total = np.bincount(cell, np.repeat(x, n) * vx[place], minlength=(b - a) * v.n)
        total[np.bincount(cell, minlength=(b - a) * v.n) == 0] = -np.inf
        return total.reshape(b - a, v.n)

    return score


def sparse_topk(queries: DataFrame, items: DataFrame, key: str, k: int = 20, digits: int = 6, q_block: int = QUESTION_BLOCK, v_block: int = ITEM_BLOCK) -> DataFrame:
    """Best items per question by the dot product of sparse rows (id, index, value).

    The entries of a row are brought together once. Question blocks meet item blocks in bounded
    groups, each gives back its k best, so no pair but those ever leaves a task and a common
    index makes no crowded group. Items that share no index with a question are no hits.
    """
    listed = lambda df, name, out: df.groupBy(F.col(name).alias(out)).agg(F.collect_list("index").alias("i"), F.collect_list(F.col("value").cast("double")).alias("x"))
    some = lambda df: df.where(F.col("index").isNotNull() & F.col("value").isNotNull())
    q, v = listed(some(queries), "query_id", "query_id"), listed(some(items), key, "key")

    def rank(qp: pd.DataFrame, vp: pd.DataFrame) -> list[pd.DataFrame]:
        parts = _rank_block(qp["query_id"].to_numpy(), vp["key"].to_numpy(), k, digits, _sparse_scores(SparseRows(qp["i"], qp["x"]), SparseRows(vp["i"], vp["x"])))
        return [p[p["score"] > -np.inf] for p in parts]

    ranked = top_k(_by_blocks(q, v, k, rank, _result(q, v), q_block, v_block), ["query_id"], [F.desc("score"), F.asc("key")], k)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")
