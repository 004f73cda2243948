"""Repeated byte strings: interval expansion on a Burrows-Wheeler transform, bounded by a length.

Every string of ``length`` bytes has one anchor, the leftmost least hash of its grams, which its
own bytes decide; equal strings have equal anchors. Neighbouring strings with one anchor form a
fragment. Fragments meet by the hash of their anchor's gram: one that occurs twice is repeated as
a whole, and unequal ones that share an anchor are compared string by string in a Burrows-Wheeler
transform of their bytes. Answers go back to blocks of documents, which cut their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import map_batches, stage, table, utf8

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 16 << 20
#: Unequal fragments of one anchor that are compared in one task; more are split by what their strings share.
MOST_KINDS = 4096
SPLIT_STARTS = 4
#: Bytes that are hashed at once, and bytes of fragments in one transform.
PIECE_BYTES = 1 << 18
TRANSFORM_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(count, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Fragments of texts: anchors, ranges of strings and their hashes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.power, self.inverse = _powers(1024)

    def fragments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(g, f, low, high, anchor) of the fragments in ``data``, in order.

        Texts lie at [starts, ends); strings start at low, low + 1, ..., high - 1. ``g`` hashes
        the anchor's gram; ``f`` the bytes of all strings of the fragment and their place.
        """
        n, length, gram = len(data), self.length, self.gram
        width = length - gram + 1
        if len(self.power) <= n:
            self.power, self.inverse = _powers(2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(VALUES[data] * self.power[:n], out=sums[1:])
        grams = _mixed((sums[gram:] - sums[:-gram]) * self.inverse[: n - gram + 1])
        bits = np.uint64(max(int(n).bit_length(), 1))
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        count = np.maximum(ends - starts - length + 1, 0)
        first, count = starts[count > 0], count[count > 0]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        if not len(at):
            none = np.zeros(0, dtype=np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        mine = anchor[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)
        low, where = at[new], mine[new]
        high = at[np.concatenate([np.nonzero(new)[0][1:], [len(at)]]) - 1] + 1
        stop = high - 1 + length
        whole = (sums[stop] - sums[low]) * self.inverse[low]
        place = ((stop - low).astype(np.uint64) << np.uint64(32)) | (where - low).astype(np.uint64)
        return grams[where], _mixed(whole ^ _mixed(place * np.uint64(BASE))), low, high, where

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(data, number of each text, its start there, its end) of pieces of bounded size.

        A long text goes on in the next piece so that each of its strings lies in exactly one.
        """
        held, numbers, offsets, size = [], [], [], 0
        step = PIECE_BYTES
        for i, text in enumerate(texts):
            for at in range(0, max(len(text) - self.length + 1, 1), step):
                part = text[at : at + step + self.length - 1]
                if len(part) < self.length:
                    continue
                held.append(part)
                numbers.append(i)
                offsets.append(at)
                size += len(part)
                if size >= step:
                    yield self._piece(held, numbers, offsets)
                    held, numbers, offsets, size = [], [], [], 0
        if held:
            yield self._piece(held, numbers, offsets)

    @staticmethod
    def _piece(held: list[bytes], numbers: list[int], offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in held])
        return np.frombuffer(b"".join(held), dtype=np.uint8), np.array(numbers), np.array(offsets), np.concatenate([[0], np.cumsum(sizes)])


def transform(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes of ``parts``, the Burrows-Wheeler transform, its last-first map and the symbols' starts.

    Each part ends in a symbol of its own, smaller than all bytes. Suffixes are sorted by
    doubling until all differ: no part is equal to another beyond its end.
    """
    m = len(parts)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int64) + m
    text[ends] = np.arange(m)
    n = len(text)
    order = np.argsort(text, kind="stable")
    named = text[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], named[1:] != named[:-1]]))
    step = 1
    while rank[order[-1]] < n - 1 and step <= n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        named = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], named[1:] != named[:-1]]))
        step *= 2
    bwt = text[order - 1]
    last_first = np.empty(n, dtype=np.int64)
    last_first[np.argsort(bwt, kind="stable")] = np.arange(n)
    return order, bwt, last_first, np.searchsorted(text[order], np.arange(m + 257))


def common_prefixes(bwt: np.ndarray, last_first: np.ndarray, symbols: np.ndarray, ends: int, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, or ``length`` where it is at least that long.

    Breadth first: level l holds intervals of suffixes that start with one string of l bytes.
    Extending a string to the left by each byte that stands before it in its interval gives
    intervals of level l + 1. The place where such an interval ends has common prefix l if none
    is known there yet, and only then does the interval go on. Ends of parts are never passed.
    """
    n = len(bwt)
    prefix = np.full(n + 1, length, dtype=np.int32)
    starts = np.unique(symbols[:-1])
    prefix[starts[starts < n]] = 0
    prefix[n] = 0
    low, high = symbols[:-1], symbols[1:]
    keep = low < high
    low, high = low[keep], high[keep]
    for level in range(1, length):
        if not len(low):
            break
        widths = high - low
        owner = np.repeat(np.arange(len(low)), widths)
        inside = np.repeat(low - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())
        byte = bwt[inside]
        real = byte >= ends
        owner, byte, target = owner[real], byte[real], last_first[inside[real]]
        by = np.argsort(target)
        owner, byte, target = owner[by], byte[by], target[by]
        last = np.ones(len(target), dtype=bool)
        last[:-1] = (target[1:] != target[:-1] + 1) | (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])
        stop = np.nonzero(last)[0]
        high = target[stop] + 1
        low = target[np.concatenate([[0], stop[:-1] + 1])] if len(stop) else high
        new = prefix[high] == length
        low, high = low[new], high[new]
        prefix[high] = level
    return prefix[:n]


def repeated_starts(parts: list[bytes], times: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts of its strings of ``length`` bytes that occur elsewhere too.

    ``times`` says how often each part stands in the corpus; a string counts once per occurrence.
    """
    order, bwt, last_first, symbols = transform(parts)
    prefix = common_prefixes(bwt, last_first, symbols, len(parts), length)
    group = np.cumsum(prefix < length)
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    part = np.searchsorted(begins, order, side="right") - 1
    inside = order - begins[part]
    fits = inside + length <= np.diff(begins)[part] - 1
    total = np.bincount(group[fits], times[part[fits]], len(order) + 2)
    found = fits & (total[group] > 1)
    out: list[np.ndarray] = []
    by = np.lexsort((inside[found], part[found]))
    p, s = part[found][by], inside[found][by]
    for a, b in zip(np.searchsorted(p, np.arange(len(parts))), np.searchsorted(p, np.arange(len(parts)), side="right"), strict=True):
        out.append(s[a:b])
    return out


def _runs(starts: np.ndarray) -> bytes:
    """Starts as (first, one past last) pairs of 32-bit numbers."""
    if not len(starts):
        return b""
    cut = np.nonzero(np.diff(starts) != 1)[0]
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + 1], axis=1).astype("<i4").tobytes()


def _describe(length: int, gram: int):
    """Fragments of the documents of a batch, folded by block."""
    schema = ["block", "g", "f", "n", "doc", "low", "size"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length, gram)
        for batch in batches:
            blocks, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t or b"" for t in utf8(batch.column(2))]
            found = []
            for data, number, offset, bounds in hasher.pieces(texts):
                g, f, low, high, _ = hasher.fragments(data, bounds[:-1], bounds[1:])
                which = np.searchsorted(bounds, low, side="right") - 1
                doc = number[which]
                found.append((blocks[doc], g.view(np.int64), f.view(np.int64), docs[doc], low - bounds[which] + offset[which], high - low + length - 1))
            if not found:
                continue
            block, g, f, doc, low, size = map(np.concatenate, zip(*found, strict=True))
            by = np.lexsort((f, g, block))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (block[by][1:] != block[by][:-1]) | (g[by][1:] != g[by][:-1]) | (f[by][1:] != f[by][:-1])
            at = np.nonzero(new)[0]
            one = by[at]
            counts = np.diff(np.concatenate([at, [len(by)]]))
            for i in range(0, len(one), 200_000):
                o = one[i : i + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (block[o].astype(np.int32), g[o], f[o], counts[i : i + 200_000].astype(np.int32), doc[o], low[o].astype(np.int64), size[o].astype(np.int32))], names=schema
                )

    return work


def _split(length: int, gram: int):
    """Fragments cut into runs of a few strings, each with a hash of the bytes that all strings of its run share.

    Runs count from the anchor, so equal strings lie in runs of one number; the shared bytes are
    all but a few, so unequal runs of one hash differ in those few bytes only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length, gram)
        for batch in batches:
            out: list[tuple] = []
            for block, g, f, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchor = int(hasher.fragments(np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)]))[4][0])
                count = len(data) - length + 1
                for run in range(max(anchor - count + 1, 0) // SPLIT_STARTS, anchor // SPLIT_STARTS + 1):
                    last = anchor - run * SPLIT_STARTS
                    a, b = max(last - SPLIT_STARTS + 1, 0), min(last, count - 1)
                    shared = data[last : last - SPLIT_STARTS + 1 + length]
                    part = data[a : b + length]
                    key = xxhash.xxh64_intdigest(shared, (g + run) & MASK)
                    out.append((block, g, f, n, a, b - a + 1, key - (1 << 64) if key >> 63 else key, xxhash.xxh64_intdigest(part) - (1 << 63), part))
            names = ["block", "g", "f", "n", "off", "starts", "key", "part", "bytes"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return work


def _compare(length: int):
    """Whole groups of fragments (rows of one key), up to a bound of bytes at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            starts = repeated_starts([h[6] for h in held], np.array([h[3] for h in held]), length)
            rows = [(h[0], h[1], h[2], _runs(s + h[4])) for h, s in zip(held, starts, strict=True) if len(s) and h[3] == 1]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                names=["block", "g", "f", "runs"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TRANSFORM_BYTES and row[5] != held[-1][5]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush()

    return work


def _cut(length: int, gram: int, result):
    """A block of documents with the answers for its fragments: ``result`` makes a row of each text and its removed runs."""

    def work(docs, answers):
        hasher = Hasher(length, gram)
        texts = [t or b"" for t in utf8(docs.column("text").combine_chunks())] if docs.num_rows else []
        known: dict[tuple[int, int], bytes | None] = {}
        for gi, fi, runs in zip(*(answers.column(c).to_pylist() for c in ("g", "f", "runs")), strict=True):
            before = known.get((gi, fi), b"")
            known[gi, fi] = None if runs is None or before is None else before + runs
        marks: list[list[tuple[int, int]]] = [[] for _ in texts]
        gs = np.unique(answers.column("g").to_numpy()) if known else np.zeros(0, dtype=np.int64)
        for data, number, offset, bounds in hasher.pieces(texts) if known else ():
            g, f, low, high, _ = hasher.fragments(data, bounds[:-1], bounds[1:])
            g, f = g.view(np.int64), f.view(np.int64)
            near = np.searchsorted(gs, g)
            likely = np.nonzero(gs[np.minimum(near, len(gs) - 1)] == g)[0]
            which = np.searchsorted(bounds, low[likely], side="right") - 1
            base = low[likely] - bounds[which] + offset[which]
            for gi, fi, doc, at, many in zip(g[likely].tolist(), f[likely].tolist(), number[which].tolist(), base.tolist(), (high - low)[likely].tolist(), strict=True):
                runs = known.get((gi, fi), b"")
                if runs is None:
                    marks[doc].append((at, at + many - 1 + length))
                elif runs:
                    marks[doc] += [(at + a, at + b - 1 + length) for a, b in np.frombuffer(runs, dtype="<i4").reshape(-1, 2).tolist()]
        return result(docs, texts, [_united(sorted(m)) for m in marks])

    return work


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _spans(docs, texts, spans):
    """Every row's id with its removed spans."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind)})


def _digest(docs, texts, spans):
    """Every row's id with the sizes and the digest of what is kept."""
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()),
        }
    )


def _fragment_bytes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(block, g, f, n, kinds, bytes) of fragments given by text and place."""
    wanted = parts.groupBy("doc").agg(F.collect_list(F.struct("g", "f", F.col("times").alias("n"), "kinds", "block", "low", "size")).alias("wanted"))
    held = rows.join(wanted, "doc").select(F.col("text").cast("binary").alias("text"), F.explode("wanted").alias("w"))
    return held.select("w.block", "w.g", "w.f", "w.n", "w.kinds", F.substring("text", F.col("w.low").cast("int") + 1, F.col("w.size")).alias("bytes"))


def _answered(docs: DataFrame, text: str, doc_id: str, length: int, gram: int, most_kinds: int, result, schema: T.StructType) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(total // BLOCK_BYTES) + 1
    rows = rows.withColumn("doc", F.xxhash64(F.xxhash64("doc_id"), F.xxhash64("text"))).withColumn("block", F.pmod("doc", F.lit(blocks)).cast("int"))
    parts = map_batches(rows.select("block", "doc", "text"), _describe(length, gram), "block int, g long, f long, n int, doc long, low long, size int")
    same, anchor = Window.partitionBy("g", "f"), Window.partitionBy("g")
    # One shuffle by anchor serves all four sums.
    parts = parts.repartition("g").withColumn("first", F.row_number().over(same.orderBy("block", "doc", "low")) == 1).withColumn("times", F.sum("n").over(same).cast("int"))
    parts = parts.withColumn("kinds", F.sum(F.col("first").cast("int")).over(anchor)).withColumn("all", F.sum("n").over(anchor))
    parts = stage(parts.where("all > 1").drop("all", "n"), "fragments")

    unequal = stage(_fragment_bytes(rows, parts.where("kinds > 1 AND first")), "unequal")  # the texts are shuffled once for all of them
    dealt = unequal.where(F.col("kinds") <= most_kinds).repartition(blocks, "g").dropDuplicates(["g", "f"])
    dealt = dealt.select("block", "g", "f", "n", F.lit(0).alias("off"), F.col("g").alias("key"), "bytes").sortWithinPartitions("key", "f")
    partly = map_batches(dealt, _compare(length), "block int, g long, f long, runs binary")
    whole = parts.where("times > 1").select("block", "g", "f").distinct().select("block", "g", "f", F.lit(None).cast("binary").alias("runs"))
    crowded = unequal.where(F.col("kinds") > most_kinds)
    if not crowded.isEmpty():
        cut = map_batches(crowded.dropDuplicates(["g", "f"]).select("block", "g", "f", "n", "bytes"), _split(length, gram), "block int, g long, f long, n int, off int, starts int, key long, part long, bytes binary")
        alike = Window.partitionBy("key", "part")
        cut = cut.repartition(blocks, "key").withColumn("first", F.row_number().over(alike.orderBy("block", "g", "f", "off")) == 1).withColumn("times", F.sum("n").over(alike).cast("int"))
        cut = stage(cut, "runs")
        firsts = cut.where("first").select("block", "g", "f", F.col("times").alias("n"), "off", "key", "bytes").repartition(blocks, "key").sortWithinPartitions("key", "g", "f")
        partly = partly.unionByName(map_batches(firsts, _compare(length), "block int, g long, f long, runs binary"))
        pair = F.concat(*[F.expr(f"reverse(unhex(lpad(hex({x}), 8, '0')))") for x in ("off", "off + starts")])
        whole = whole.unionByName(cut.where("times > 1 AND n = 1").select("block", "g", "f", pair.alias("runs")))
    answers = stage(partly.unionByName(whole), "answers")
    return rows.select("block", "doc_id", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut(length, gram, result), schema)


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, most_kinds: int = MOST_KINDS) -> DataFrame:
    """(doc_id, n_bytes, spans): the maximal runs of bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Texts are taken as UTF-8 bytes, null as empty; strings never cross documents; both places of
    a repeated string count, in one text or two. Shorter texts have no spans. Rows are kept as
    they are, repeated ids included; an empty table gives an empty result; other columns are not
    read. Long texts are hashed piece by piece. Where more than ``most_kinds`` unequal fragments share
    an anchor, as at the edge of a passage that very many texts quote, they are compared in small
    runs of strings that meet only where nearly all of their bytes agree, equal ones as one.
    """
    schema = T.StructType([docs.select(F.col(doc_id).alias("doc_id")).schema[0], *T.StructType.fromDDL("n_bytes long, spans array<struct<start: long, stop: long>>").fields])
    return _answered(docs, text, doc_id, length, gram, most_kinds, _spans, schema)


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, digest of the rest."""
    docs = table(spark, sf_dir, "documents")
    schema = T.StructType([docs.select("doc_id").schema[0], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    return _answered(docs, "text", "doc_id", LENGTH, GRAM, MOST_KINDS, _digest, schema)
