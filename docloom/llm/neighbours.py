"""Approximate nearest neighbours: cross-polytope hashing with several probes and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import map_batches, stage, table
from docloom.operators.skew import top_k

NEAREST = 20
TABLES = 6
#: Probes are set so that this share of the neighbours of a sample of queries is found.
AIM = 0.98
SAMPLE_QUERIES = 48
#: Rows of a bucket, and queries that probe it, in one group; fuller buckets are split.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048


class Rotations:
    """Pseudo-random rotations: three rounds of random signs and a fast Hadamard transform, one set per table."""

    def __init__(self, width: int, tables: int = TABLES):
        self.width = 1 << max(int(width - 1).bit_length(), 0)
        self.signs = np.random.default_rng(5).choice([-1.0, 1.0], (tables, 3, self.width))

    def turn(self, x: np.ndarray, number: int) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for signs in self.signs[number]:
            x = x * signs
            half = 1
            while half < self.width:
                x = x.reshape(len(x), -1, 2, half)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), self.width)
                half *= 2
        return x

    def axes(self, x: np.ndarray, number: int) -> np.ndarray:
        """Closeness of each vector to each signed axis."""
        turned = self.turn(x, number)
        return np.concatenate([turned, -turned], axis=1)

    def buckets(self, x: np.ndarray, number: int) -> np.ndarray:
        return np.argmax(self.axes(x, number), axis=1)


def lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors whose angles order inner products: rows get the part that ``longest`` leaves, queries (None) get 0."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is None:
        return np.hstack([x / norms, np.zeros_like(norms)])
    return np.hstack([x / longest, np.sqrt(np.maximum(1 - (norms / longest) ** 2, 0))])


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order."""
    return (rows * query).sum(axis=1)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The ``k`` best rows of a block for each query, without rows of the query's own id; ties to the smaller id."""
    rough = queries @ rows.T
    for i, scores in enumerate(rough):
        at = np.arange(len(rows))
        if len(rows) > k + 1:
            bound = np.partition(scores, len(rows) - k - 1)[len(rows) - k - 1]
            at = np.nonzero(scores >= bound - 1e-9 * max(1.0, abs(bound)))[0]
        at = at[ids[at] != query_ids[i]]
        score = exact(queries[i], rows[at])
        for j in np.lexsort((ids[at], -score))[:k]:
            yield int(query_ids[i]), int(ids[at[j]]), float(score[j])


def _hits(found: list[tuple[int, int, float]]) -> dict[str, pa.Array]:
    return {"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())}


def usable(vectors: DataFrame, vec: str, vec_id: str) -> DataFrame:
    """(id, v) of the rows that take part: no null, zero or non-finite vectors, all of the commonest length; copies folded."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0)).distinct()
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    first = lengths.first()
    return rows.where(F.size(v) == (first["n"] if first else 0))


def _brute(queries: np.ndarray, query_ids: np.ndarray, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(_hits(list(nearest(queries, query_ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k))))

    return work


def probes_needed(rows: DataFrame, queries: DataFrame, turns: Rotations, longest: float, k: int, aim: float = AIM) -> int:
    """Probes per table that find ``aim`` of the true neighbours of a bounded sample of queries.

    The sample's neighbours are found by brute force over all rows.
    """
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()
    if not sample:
        return 1
    q, ids = np.array([r["v"] for r in sample]), np.array([r["id"] for r in sample])
    true = top_k(map_batches(rows, _brute(q, ids, k), "query_id long, vec_id long, score double"), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    true = true.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v").collect()  # sample x k rows
    if not true:
        return 1
    number = {int(i): n for n, i in enumerate(ids)}
    mine, found = np.array([number[r["query_id"]] for r in true]), np.array([r["v"] for r in true])
    lift_q, lift_x = lifted(q, None), lifted(found, longest)
    least = np.full(len(true), 2 * turns.width)
    for t in range(len(turns.signs)):
        closeness = turns.axes(lift_q, t)
        bucket = turns.buckets(lift_x, t)
        own = closeness[mine, bucket]
        least = np.minimum(least, (closeness[mine] > own[:, None]).sum(axis=1) + 1)
    return int(np.sort(least)[min(int(np.ceil(aim * len(least))), len(least)) - 1])


def search(rows: DataFrame, queries: DataFrame, k: int = NEAREST, tables: int = TABLES, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of largest inner product that are found.

    ``rows`` and ``queries`` hold id and v as ``usable`` gives them. All rows are indexed: in each
    table a row lies in the bucket of its nearest signed axis, a query looks into the buckets of
    its nearest axes, and candidates are rescored exactly. Copies of one vector stand for each
    other: only their ``k`` + 1 smallest ids are kept, as no other can be among the best. Buckets
    are split into blocks of bounded size. Queries that found fewer than ``k`` rows look into all.
    """
    rows, queries = stage(top_k(rows, ["v"], [F.asc("id")], k + 1).select("id", "v"), "vectors"), stage(queries, "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    count, longest, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turns = Rotations(width + 1, tables)
    probes = probes_needed(rows, queries, turns, longest, k, aim)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = lifted(_matrix(batch.column(1)), longest)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(turns.buckets(x, t).astype(np.int32)), *batch.columns], names=["t", "bucket", "id", "v"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = lifted(_matrix(batch.column(1)), None)
                best = np.concatenate([np.argsort(-turns.axes(x, t), axis=1, kind="stable")[:, :probes] for t in range(tables)], axis=1).astype(np.int32)
                number = np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), (len(x), 1))
                kind = pa.list_(pa.struct([("t", pa.int32()), ("bucket", pa.int32())]))
                pairs = pa.ListArray.from_arrays(
                    np.arange(len(x) + 1, dtype=np.int32) * (tables * probes), pa.StructArray.from_arrays([pa.array(number.ravel()), pa.array(best.ravel())], names=["t", "bucket"])
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, pairs.cast(kind)], names=["id", "v", "at"])

    members = map_batches(rows, hashed, "t int, bucket int, id long, v array<double>")
    asked = map_batches(queries, probed, "id long, v array<double>, at array<struct<t: int, bucket: int>>").select("id", "v", F.explode("at").alias("at")).select("at.t", "at.bucket", "id", "v")
    loads = members.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    crowds = asked.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns"))
    sizes = F.broadcast(stage(loads.join(crowds, ["t", "bucket"]), "sizes"))  # one row per table and axis

    def block(key, of):
        return F.pmod(F.xxhash64(key), F.col(of)).cast("int")

    def every(of):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    members = members.join(sizes, ["t", "bucket"]).select("t", "bucket", block("id", "parts").alias("part"), every("turns").alias("turn"), "id", "v")
    asked = asked.join(sizes, ["t", "bucket"]).select("t", "bucket", every("parts").alias("part"), block("id", "turns").alias("turn"), "id", "v")

    def rerank(mine, theirs):
        found = []
        if mine.num_rows and theirs.num_rows:
            found = list(nearest(_matrix(theirs.column("v")), theirs.column("id").to_numpy(), _matrix(mine.column("v")), mine.column("id").to_numpy(), k))
        return pa.table(_hits(found))

    keys = ["t", "bucket", "part", "turn"]
    hits = members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double").distinct()
    order = [F.desc("score"), F.asc("vec_id")]
    best = stage(top_k(hits, ["query_id"], order, k), "best")
    short = queries.join(best.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, count - 1)), "id", "left_anti")
    if not short.isEmpty():
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(top_k(everywhere(rows, short, k), ["query_id"], order, k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def everywhere(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows of each block of rows for each query: blocks of queries meet blocks of rows of bounded size."""
    parts = rows.count() // BLOCK_ROWS + 1
    blocks = queries.count() // BLOCK_QUERIES + 1
    mine = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("turn"), "id", "v")
    theirs = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("turn"), "id", "v")

    def work(a, b):
        found = list(nearest(_matrix(b.column("v")), b.column("id").to_numpy(), _matrix(a.column("v")), a.column("id").to_numpy(), k)) if a.num_rows and b.num_rows else []
        return pa.table(_hits(found))

    mine, theirs = (x.withColumn("part", F.col("part").cast("int")) for x in (mine, theirs))
    return mine.groupBy("part", "turn").cogroup(theirs.groupBy("part", "turn")).applyInArrow(work, "query_id long, vec_id long, score double")


def nearest_rows(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", every: int = 20, k: int = NEAREST) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``, by largest inner product.

    Null, zero and non-finite vectors and null ids take no part, nor do vectors of another length
    than the commonest; repeated rows count once; rows of the query's own id are left out. An
    empty table gives an empty result; other columns are not read.
    """
    rows = stage(usable(vectors, vec, vec_id), "usable")
    return search(rows, rows.where(F.col("id") % every == 0), k)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 rows per query: query_id, rank, vec_id, score."""
    return nearest_rows(table(spark, sf_dir, "embeddings"))
