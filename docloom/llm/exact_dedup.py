"""Exact dedup with an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fields, first_row_id, fresh, join_groups, map_batches, stage, table, utf8

#: Deleted before texts are compared: U+0020 and U+0009 to U+000D.
WHITE = b" \t\n\x0b\x0c\r"
BUCKET_BYTES = 16 << 20
LOCAL_BYTES = 64 << 20
MAX_DEPTH = 20


def build_directory(weights: np.ndarray, capacity: float) -> tuple[np.ndarray, int, int]:
    """Directory of an extendible hash over cells of the key's leading bits.

    ``weights`` holds the load of each of 2**d cells. The directory starts with one bucket;
    an overfull bucket splits on its next bit, and the directory doubles when that bucket
    used all of its bits. Returns (bucket of each slot, depth, number of buckets). A bucket
    that is overfull at the last bit stays: its entries chain.
    """
    limit = int(len(weights)).bit_length() - 1
    sums = np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)])
    load = lambda prefix, bits: sums[(prefix + 1) << (limit - bits)] - sums[prefix << (limit - bits)]
    slots, depth, buckets, todo = np.zeros(1, dtype=np.int64), 0, [(0, 0)], [0]
    while todo:
        b = todo.pop()
        prefix, bits = buckets[b]
        if bits == limit or load(prefix, bits) <= capacity:
            continue
        if bits == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        buckets[b] = (prefix * 2, bits + 1)
        buckets.append((prefix * 2 + 1, bits + 1))
        width = depth - bits - 1
        slots[(prefix * 2 + 1) << width : (prefix * 2 + 2) << width] = len(buckets) - 1
        todo += [b, len(buckets) - 1]
    return slots, depth, len(buckets)


def _fold(batches: Iterator[pa.RecordBatch], names: list[str], text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows with id, length, key and digest; ``rep`` is the first equal text this task has seen."""
    row, seen, held = first_row_id(), {}, 0
    for batch in batches:
        rows, reps, shas, keys = [], [], [], []
        for text in utf8(batch.column(text_at)):
            body = (text or b"").translate(None, WHITE)
            rep = seen.get(body)
            if rep is None:
                if held > limit:
                    seen, held = {}, 0
                seen[body] = rep = row
                held += len(body)
            rows.append(row)
            reps.append(rep)
            shas.append(hashlib.sha256(body).hexdigest())
            keys.append(xxhash.xxh64_intdigest(body))
            row += 1
        lengths = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).cast(pa.int64())
        more = [pa.array(rows, pa.int64()), pa.array(reps, pa.int64()), lengths, pa.array(shas, pa.string()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of a run of buckets, bucket after bucket: colliding keys chain, bytes decide."""
    bucket, chains = None, {}
    for batch in batches:
        classes, places = [], []
        for b, key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
            if b != bucket:
                bucket, chains = b, {}
            body = (text or b"").translate(None, WHITE)
            chain = chains.setdefault(key, [])
            place = next((i for i, (other, _) in enumerate(chain) if other == body), len(chain))
            if place == len(chain):
                chain.append((body, row))
            classes.append(chain[place][1])
            places.append(place)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.int32()), batch.column(2), pa.array(classes, pa.int64())], names=["bucket", "key", "place", "row", "class"]
        )


def dedup_index(rows: DataFrame, text: str, key: str, row: str, rep: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The index of all distinct texts, on shared files: (bucket, key, place in chain, row, class)."""
    spark = rows.sparkSession
    firsts = rows.where(F.col(row) == F.col(rep))
    size = F.octet_length(F.coalesce(text, F.lit(""))) + 64
    total = firsts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    cell_bits = min(MAX_DEPTH, max(4, int(total // bucket_bytes).bit_length() + 3))
    cell = lambda bits: F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")
    weights = np.zeros(1 << cell_bits)
    for c, w in firsts.groupBy(cell(cell_bits).alias("cell")).agg(F.sum(size).alias("w")).collect():  # 2**20 cells at most
        weights[c] = w
    slots, depth, count = build_directory(weights, bucket_bytes)
    directory = spark.createDataFrame([(i, int(b)) for i, b in enumerate(slots)], "slot long, bucket long")  # 2**20 slots at most
    owned = firsts.select(cell(depth).alias("slot"), F.col(key).alias("key"), F.col(row).alias("row"), F.col(text).alias("text")).join(F.broadcast(directory), "slot")
    owners = max(count, 1)
    dealt = owned.select("bucket", "key", "row", "text").repartition(owners, "bucket").sortWithinPartitions("bucket", "key", "row")
    return stage(map_batches(dealt, _own, "bucket long, key long, place int, row long, class long"), "index")


def dedup_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with its class of equal texts.

    Texts are equal when the same after white space (U+0020, U+0009 to U+000D) is deleted;
    null counts as empty, so null, empty and blank texts form one class. The row with the most
    code points stays, then the smallest id (null ids last), then the first stored; of repeated
    rows exactly one stays. An empty table gives an empty result. All columns of ``docs`` are
    kept; the added ones get names that clash with none, returned as the second value:
    keep_id, group_size, kept, sha.

    Each map task folds the copies it meets, so a text of a third of all rows reaches its owner
    once per task. Owners hold one bucket at a time; joins back spread hot classes over salts.
    """
    new = {}
    for base in ("row", "rep", "length", "sha", "key", "class", "group_size", "keep_id", "kept", "keep"):
        new[base] = fresh([*docs.columns, *new.values()], base if base not in docs.columns else "_" + base)
    schema = fields(docs.schema, (new["row"], T.LongType()), (new["rep"], T.LongType()), (new["length"], T.LongType()), (new["sha"], T.StringType()), (new["key"], T.LongType()))
    names, at = schema.names, docs.columns.index(text)
    rows = stage(map_batches(docs, lambda it: _fold(it, names, at, LOCAL_BYTES), schema), "rows")
    index = dedup_index(rows, text, new["key"], new["row"], new["rep"], bucket_bytes)
    members = rows.select(new["row"], new["rep"], new["length"], F.col(doc_id).alias(new["keep_id"]))
    members = members.join(index.select(F.col("row").alias(new["rep"]), F.col("class").alias(new["class"])), new["rep"])
    order = F.struct((-F.col(new["length"])).alias("l"), F.col(new["keep_id"]).isNull().alias("n"), F.col(new["keep_id"]).alias("i"), F.col(new["row"]).alias("r"))
    groups = members.groupBy(new["class"]).agg(F.count("*").alias(new["group_size"]), F.min(order).alias(new["keep"]))
    total = rows.count()
    found = join_groups(members.select(new["row"], new["class"]), groups, new["class"], new["group_size"], total, new["row"]).select(
        new["row"], F.col(f"{new['keep']}.i").alias(new["keep_id"]), new["group_size"], (F.col(new["row"]) == F.col(f"{new['keep']}.r")).alias(new["kept"])
    )
    return rows.drop(new["rep"], new["length"], new["key"]).join(found, new["row"]), new


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of equal texts, same columns."""
    rows, new = dedup_rows(docs, text, doc_id)
    return rows.where(new["kept"]).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: keep_id, group_size, kept, digest of the normalised text."""
    rows, new = dedup_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col(new["keep_id"]).alias("keep_id"), F.col(new["group_size"]).alias("group_size"), F.col(new["kept"]).alias("kept"), F.col(new["sha"]).alias("text_sha256"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
