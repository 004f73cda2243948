"""SimHash near-dedup: vantage-point trees over Hamming distance find all close pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fields, first_row_id, fresh, join_groups, map_batches, stage, table, utf8
from docloom.operators.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Distinct fingerprints of a shard, and of a leaf inside a shard.
SHARD_ROWS = 16_384
LEAF_ROWS = 256
#: The shard tree is fitted on a sample of this many fingerprints per shard, over 2**12 shards at most.
SAMPLE_PER_SHARD = 32
MOST_LEVELS = 12


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64 bits; each is set if over half of the shingles' hashes have it set. No words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])
    found = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        bits += np.unpackbits(found[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a row id and the fingerprint of each whole text (a signed 64-bit number); null counts as empty."""
    new: dict[str, str] = {}
    for base in ("row", "print"):
        new[base] = fresh([*docs.columns, *new.values()], base)
    schema, at = fields(docs.schema, (new["row"], T.LongType()), (new["print"], T.LongType())), docs.columns.index(text)
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = first_row_id(), {}
        for batch in batches:
            prints = []
            for value in utf8(batch.column(at)):
                if value is not None and len(value) < 4096:  # short copies are common and cheap to remember
                    found = known.get(value)
                    if found is None:
                        if len(known) >= 4096:
                            known = {}
                        found = known[value] = fingerprint(value)
                else:
                    found = fingerprint(value)
                prints.append(found)
            rows = pa.array(np.arange(row, row + len(prints), dtype=np.int64))
            row += len(prints)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=names)

    return map_batches(docs, work, schema), new


def fit_tree(sample: np.ndarray, levels: int) -> list[tuple[int, int]]:
    """Vantage points and median distances of a tree with 2**levels leaves, in heap order from 1."""
    nodes: list[tuple[int, int]] = [(0, 32)] * (1 << levels)
    members = {1: sample}
    for node in range(1, 1 << levels):
        mine = members.pop(node, sample[:0])
        if len(mine) == 0:
            members[2 * node] = members[2 * node + 1] = mine
            continue
        vantage = mine[(node * 7) % len(mine)]
        distance = np.bitwise_count(mine ^ vantage)
        middle = int(np.median(distance))
        nodes[node] = (int(vantage), middle)
        members[2 * node], members[2 * node + 1] = mine[distance <= middle], mine[distance > middle]
    return nodes


def route(prints: np.ndarray, nodes: list[tuple[int, int]], levels: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, prints at home there, prints whose ball of ``radius`` may reach into it).

    By the triangle inequality a print at distance d from the vantage point can be within the
    radius of one inside (distance <= middle) only if d - radius <= middle, and of one outside
    only if d + radius > middle. A close pair of two homes is found from the earlier home's side,
    so visitors go to later shards only.
    """
    stack = [(1, prints, prints[:0])]
    while stack:
        node, home, guests = stack.pop()
        if node >= 1 << levels:
            if len(home) or len(guests):
                yield node - (1 << levels), home, guests
            continue
        vantage, middle = nodes[node]
        vantage = np.uint64(vantage)
        dh, dg = np.bitwise_count(home ^ vantage).astype(np.int16), np.bitwise_count(guests ^ vantage).astype(np.int16)
        inside = dh <= middle
        over = inside & (dh + radius > middle)
        stack.append((2 * node, home[inside], guests[dg - radius <= middle]))
        stack.append((2 * node + 1, home[~inside], np.concatenate([home[over], guests[dg + radius > middle]])))


def close_pairs(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with queries[i] and points[j] within ``radius``: a vantage-point tree descended for all queries at once."""
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF_ROWS:
            vantage = points[p[len(p) // 2]]
            dp = np.bitwise_count(points[p] ^ vantage)
            middle = int(np.median(dp))
            inside = dp <= middle
            if not inside.all():
                dq = np.bitwise_count(queries[q] ^ vantage).astype(np.int16)
                stack.append((p[inside], q[dq - radius <= middle]))
                stack.append((p[~inside], q[dq + radius > middle]))
                continue
        step = max(1, (1 << 20) // len(p))
        for at in range(0, len(q), step):
            i, j = np.nonzero(np.bitwise_count(queries[q[at : at + step], None] ^ points[p][None, :]) <= radius)
            yield q[at + i], p[j]


def forest(count: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of ``count`` nodes after all pairs are united; roots are smallest numbers."""
    root = np.arange(count)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``radius`` of each other.

    ``prints`` holds distinct numbers in its column print. A vantage-point tree, fitted on a
    bounded sample, deals them into shards of about ``shard_rows``; each fingerprint also visits
    the later shards its ball reaches. A shard finds every close pair with a tree of its own and
    gives back a spanning forest of them, never all pairs of a dense group.
    """
    count = prints.count()
    levels = min(MOST_LEVELS, max(int(count // shard_rows).bit_length() - 1, 0)) if count >= shard_rows else 0
    sample = prints.orderBy(F.xxhash64("print"), "print").limit(SAMPLE_PER_SHARD << levels).collect() if levels else []
    nodes = fit_tree(np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64), levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shards, homes, guests = [], [], []
            for shard, home, guest in route(mine, nodes, levels, radius):
                shards.append(shard)
                homes.append(home.tobytes())
                guests.append(guest.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(homes, pa.binary()), pa.array(guests, pa.binary())], names=["shard", "home", "guests"])

    def search(shard):
        read = lambda name: np.unique(np.frombuffer(b"".join(shard.column(name).to_pylist()), dtype=np.uint64))
        home, guests = read("home"), read("guests")
        everyone = np.concatenate([home, guests])
        root = forest(len(everyone), close_pairs(home, everyone, radius))
        moved = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": everyone[root[moved]].view(np.int64), "b": everyone[moved].view(np.int64)})

    dealt = map_batches(prints.select("print"), deal, "shard int, home binary, guests binary")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def components(rows: DataFrame, new: dict[str, str], doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(print, size, component, component_id) of each distinct fingerprint of staged ``rows``.

    ``component`` is the print that names the component, ``component_id`` the smallest doc_id it
    reaches; two components may share that id where ids repeat or are null.
    """
    prints = rows.groupBy(F.col(new["print"]).alias("print")).agg(F.min(doc_id).alias("least"), F.count("*").alias("size"))
    prints = stage(prints, "prints")
    edges = stage(links(prints, radius), "links")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = connected_components(ends, edges, []) if not edges.isEmpty() else ends.withColumn("component", F.col("node"))
    joined = prints.join(labels.select(F.col("node").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_prints"))
    found = join_groups(joined.select("print", "size", "component"), least, "component", "_prints", prints.count(), "print")
    return found.select("print", "size", "component", "component_id")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the fingerprint of each text and the smallest doc_id its near-duplicate links reach.

    Fingerprints link at ``radius`` or fewer differing bits; all links count, so repeated rows,
    empty texts and large groups need no special rule. Null ids never name a group unless it has
    no other id. An empty table gives an empty result. Added columns get names that clash with none.
    """
    found, new = fingerprints(docs, text)
    rows = stage(found, "fingerprints")
    for base in ("component_id", "group"):
        new[base] = fresh([*rows.columns, *new.values()], base)
    groups = components(rows, new, doc_id, radius)
    groups = groups.select(F.col("print").alias(new["print"]), F.col("component_id").alias(new["component_id"]), F.col("size").alias(new["group"]))
    return join_groups(rows, groups, new["print"], new["group"], rows.count(), new["row"]), new


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near duplicates; same columns.

    The row with the smallest doc_id stays, null ids last; of rows that share it, the first
    stored. Groups are told apart by their fingerprints, so ids may be null or repeat. Null and
    empty texts form one group; an empty table stays empty.
    """
    found, new = fingerprints(docs, text)
    rows = stage(found, "fingerprints")
    groups = components(rows, new, doc_id).select(F.col("print").alias(new["print"]), "size", "component")
    members = rows.select(new["row"], new["print"], F.col(doc_id).alias("_id"))
    known = join_groups(members, groups, new["print"], "size", rows.count(), new["row"])
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col(new["row"]).alias("r")))
    best = known.groupBy("component").agg(first.alias("b")).select(F.col("b.r").alias(new["row"]))
    return rows.join(best, new["row"]).select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint in hexadecimal and the smallest doc_id it is linked with."""
    rows, new = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex(new["print"]), 16, "0")).alias("fingerprint"), F.col(new["component_id"]).alias("component_id"))
