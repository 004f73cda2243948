"""Periodic runs of words, found on a Re-Pair grammar."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fresh, map_batches, table, utf8

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of the texts that share one grammar; a longer text has one of its own.
BATCH_WORDS = 1 << 19
#: Rounds of pair replacement stop when one shortens the texts by less than this share.
LEAST_GAIN = 1 / 200
#: A boundary with more open distances than this is compared whole, in linear time.
MOST_DISTANCES = 64
#: Words around a boundary that a first look compares, and words of the key that finds distances.
LOOK, GRAM = 16, 4


class Grammar:
    """Straight-line grammar of several texts: terminals are word ids, rules are pairs.

    ``left`` and ``right`` hold a rule's two symbols, ``size`` the words of a symbol and ``place``
    one place of it in the joined texts, all by symbol number; terminals come first. ``open`` marks
    the places of the top string whose pair may stand elsewhere too.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, terminals: int):
        self.terminals = terminals
        self.left = self.right = np.full(terminals, -1, np.int64)
        self.size, self.place = np.ones(terminals, np.int64), np.zeros(terminals, np.int64)
        self.top, self.doc, self.at = ids.astype(np.int64), doc, np.arange(len(ids))
        self.open = np.r_[doc[1:] == doc[:-1], False]
        self.place[self.top[::-1]] = self.at[::-1]

    def add(self, pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """New symbols for (left, right) ``pairs`` that stand at ``at``."""
        fresh_ = len(self.size) + np.arange(len(pairs))
        self.left, self.right = np.r_[self.left, pairs[:, 0]], np.r_[self.right, pairs[:, 1]]
        self.size, self.place = np.r_[self.size, self.size[pairs].sum(axis=1)], np.r_[self.place, at]
        return fresh_

    def replace(self, first: np.ndarray, symbols: np.ndarray) -> None:
        """Put ``symbols`` for the pairs that start at the places ``first`` of the top string."""
        self.top = self.top.copy()
        self.top[first] = symbols
        keep = np.ones(len(self.top), bool)
        keep[first + 1] = False
        self.open[first] = True
        self.open[first[first > 0] - 1] = True
        self.top, self.doc, self.at, self.open = self.top[keep], self.doc[keep], self.at[keep], self.open[keep]
        self.open[:-1] &= self.doc[1:] == self.doc[:-1]
        self.open[-1] = False

    def pair_up(self) -> bool:
        """One round of Re-Pair: each pair that is more frequent than the pairs it overlaps gets a symbol.

        Equal counts are ordered by a hash, so that a text without repeats of its own folds in
        halves. Overlapping copies of one pair (aaa) are taken from the left, every other one.
        """
        live = np.flatnonzero(self.open)
        kinds, inverse, counts = np.unique(self.top[live] << 32 | self.top[live + 1], return_inverse=True, return_counts=True)
        self.open[live[counts[inverse] < 2]] = False  # a pair that stands once can only vanish
        mixed = (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mixed, counts))] = np.arange(1, len(kinds) + 1)
        rank[counts < 2] = 0
        mine, kind = np.zeros(len(self.top), np.int64), np.zeros(len(self.top), np.int64)
        mine[live], kind[live] = rank[inverse], inverse
        before, after, step = np.r_[0, mine[:-1]], np.r_[mine[1:], 0], np.arange(len(mine))
        offset = step - np.maximum.accumulate(np.where((mine != before) | (mine == 0), step, 0))
        first = np.flatnonzero((mine > 0) & (mine >= before) & (mine >= after) & (offset % 2 == 0))
        chosen, at, places, times = np.unique(kind[first], return_index=True, return_inverse=True, return_counts=True)
        worth = times > 1
        if not worth.any():
            return False
        pairs = np.stack([kinds[chosen] >> 32, kinds[chosen] & 0xFFFFFFFF], axis=1)
        symbols = np.zeros(len(chosen), np.int64)
        symbols[worth] = self.add(pairs[worth], self.at[first[at[worth]]])
        taken = worth[places]
        length = len(self.top)
        self.replace(first[taken], symbols[places[taken]])
        return length - len(self.top) >= length * LEAST_GAIN

    def close(self) -> None:
        """Fold what is left of each text into one symbol, neighbour by neighbour."""
        while True:
            start = np.r_[True, self.doc[1:] != self.doc[:-1]]
            step = np.arange(len(self.top))
            offset = step - np.maximum.accumulate(np.where(start, step, 0))
            last = np.r_[self.doc[1:] != self.doc[:-1], True]
            first = np.flatnonzero((offset % 2 == 0) & ~last)
            if not len(first):
                return
            self.replace(first, self.add(np.stack([self.top[first], self.top[first + 1]], axis=1), self.at[first]))


def build(ids: np.ndarray, doc: np.ndarray, terminals: int) -> Grammar:
    grammar = Grammar(ids, doc, terminals)
    while len(grammar.top) > 1 and grammar.pair_up():
        pass
    grammar.close()
    return grammar


def neighbours_of(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: the next place of the same ``GRAM`` words in its text, and the previous place of those that end there.

    Places without one get -1. Equal words give equal keys; unequal ones are sorted out when compared.
    """
    n = len(ids)
    ahead, behind = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    if n < GRAM:
        return ahead, behind
    key = np.zeros(n - GRAM + 1, np.uint64)
    for g in range(GRAM):
        key = (key + ids[g : n - GRAM + 1 + g].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    key = (key + doc[: n - GRAM + 1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    ahead[order[:-1][equal]] = order[1:][equal]
    behind[order[1:][equal] + GRAM] = order[:-1][equal] + GRAM
    return ahead, behind


def look(low: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, step: int, stop: np.ndarray) -> np.ndarray:
    """How many of ``LOOK`` words agree from ``a`` and ``b`` on in direction ``step``, before ``stop`` is passed."""
    length, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(LOOK):
        x, y = a[live] + step * k, b[live] + step * k
        inside = (y < stop[live]) if step > 0 else (x >= low[live])
        live, x, y = live[inside], x[inside], y[inside]
        live = live[ids[x] == ids[y]]
        if not len(live):
            break
        length[live] += 1
    return length


def agree(ids: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """Number of equal words from places ``a`` and ``b`` on in direction ``step``, at most ``limit``."""
    done, width = 0, 64
    while done < limit:
        width = min(2 * width, limit - done)
        x, y = (ids[p + done : p + done + width] if step > 0 else ids[p - done - width + 1 : p - done + 1][::-1] for p in (a, b))
        apart = x != y
        if apart.any():
            return done + int(apart.argmax())
        done += width
    return done


def prefix_lengths(ids: np.ndarray) -> list[int]:
    """Z-function: length of the common prefix of a list and each of its ends."""
    word, n = ids.tolist(), len(ids)
    z, lo, hi = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and word[i + k] == word[k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def all_distances(ids: np.ndarray, low: int, middle: int, high: int) -> Iterator[tuple[int, int]]:
    """(distance, first place) where words may repeat ahead of a boundary, from two Z-functions."""
    right = ids[middle:high]
    forward = prefix_lengths(right)
    joined = np.r_[ids[low:middle][::-1], -1, ids[low:high][::-1]]
    back = prefix_lengths(joined)
    total = high - low
    for q in range(1, high - middle):
        left = min(back[middle - low + 1 + total - (middle - low) - q], middle - low)
        if left + forward[q] + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            yield q, middle


def crossing(ids: np.ndarray, ahead: np.ndarray, behind: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Runs that cross each boundary ``middle`` within [``low``, ``high``): rows (boundary, start, end, period).

    A run reaches at least half its length to one side. There the words at the boundary come
    again one period away, so the next places of the same words give the possible periods; all of
    them are tried, each extended both ways as far as the words agree. Of equal stretches the
    smallest period stays.
    """
    out: list[tuple[int, int, int, int]] = []
    for links, step in ((ahead, 1), (behind, -1)):
        live, far, tries = np.arange(len(middle)), middle.copy(), 0
        begin, end, period = np.zeros_like(middle), np.zeros_like(middle), np.ones_like(middle)  # the last stretch found at each boundary
        while len(live):
            far = links[far]
            ok = far >= 0
            ok &= (far + GRAM <= high[live]) if step > 0 else (far - GRAM >= low[live])
            live, far = live[ok], far[ok]
            q = np.abs(far - middle[live])
            ok = LEAST_PERIODS * q <= high[live] - low[live]
            live, far, q = live[ok], far[ok], q[ok]
            if tries == MOST_DISTANCES:
                for x in live.tolist():
                    out += whole(ids, x, int(low[x]), int(middle[x]), int(high[x]), step)
                break
            a, b = np.minimum(far, middle[live]), np.maximum(far, middle[live])
            other = np.flatnonzero((q % period[live] != 0) | (a < begin[live]) | (b > end[live]))  # a multiple gives the same stretch again
            x, a, b = live[other], a[other], b[other]
            near = look(low[x], a, b, ids, 1, high[x]) + look(low[x], a - 1, b - 1, ids, -1, high[x]) >= LOOK
            for k, i, j in zip(x[near].tolist(), a[near].tolist(), b[near].tolist(), strict=True):
                for hit in stretch(ids, k, i, j, int(low[k]), int(high[k])):
                    out.append(hit)
                    begin[k], end[k], period[k] = hit[1:]
            tries += 1
    if not out:
        return np.zeros((0, 4), np.int64)
    found = np.unique(np.array(out, np.int64), axis=0)
    return found[np.r_[True, np.any(found[1:, :3] != found[:-1, :3], axis=1)]]


def stretch(ids: np.ndarray, x: int, a: int, b: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """The stretch of period b - a around places ``a`` and ``b``, if it is long enough."""
    start = a - agree(ids, a - 1, b - 1, a - low, -1)
    end = b + agree(ids, a, b, high - b, 1)
    return [(x, start, end, b - a)] if end - start >= max(LEAST_WORDS, LEAST_PERIODS * (b - a)) else []


def whole(ids: np.ndarray, x: int, low: int, middle: int, high: int, step: int) -> list[tuple[int, int, int, int]]:
    """All runs to one side of a boundary that many distances lead to, in linear time."""
    if step > 0:
        hits = [(middle, middle + q) for q, _ in all_distances(ids, low, middle, high)]
    else:
        turned = ids[::-1]
        n = len(ids)
        hits = [(middle - q, middle) for q, _ in all_distances(turned, n - high, n - middle, n - low)]
    found, seen = [], {}
    for a, b in sorted(hits, key=lambda h: h[1] - h[0]):
        # a multiple of a period found before gives the same stretch
        if any((b - a) % q == 0 and s <= a and b <= e for (s, e), q in seen.items()):
            continue
        for hit in stretch(ids, x, a, b, low, high):
            seen.setdefault((hit[1], hit[2]), hit[3])
            found.append(hit)
    return found


def translate(grammar: Grammar, own: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period) of the runs ``own`` of symbols, at every place their symbol derives.

    ``own`` holds (symbol, start, end, period) within the symbol. Symbols are opened from the top
    down, and only those that hold a run somewhere below.
    """
    count = len(grammar.size)
    holds = np.zeros(count, bool)
    holds[own[:, 0]] = True
    inner = np.arange(grammar.terminals, count)
    while True:
        more = inner[~holds[inner] & (holds[grammar.left[inner]] | holds[grammar.right[inner]])]
        if not len(more):
            break
        holds[more] = True
    order = np.argsort(own[:, 0], kind="stable")
    own = own[order]
    first, last = np.searchsorted(own[:, 0], np.arange(count)), np.searchsorted(own[:, 0], np.arange(count), "right")
    open_ = holds[grammar.top]
    symbol, doc, at, out = grammar.top[open_], grammar.doc[open_], grammar.at[open_], []
    while len(symbol):
        n = last[symbol] - first[symbol]
        pick = np.repeat(first[symbol] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        place = np.repeat(at, n)
        out.append(np.stack([np.repeat(doc, n), place + own[pick, 1], place + own[pick, 2], own[pick, 3]], axis=1))
        left, right = grammar.left[symbol], grammar.right[symbol]
        inside = left >= 0
        left, right, doc, at = left[inside], right[inside], doc[inside], at[inside]
        symbol, doc, at = np.r_[left, right], np.r_[doc, doc], np.r_[at, at + grammar.size[left]]
        open_ = holds[symbol]
        symbol, doc, at = symbol[open_], doc[open_], at[open_]
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def merge(found: np.ndarray) -> np.ndarray:
    """Maximal stretches of (text, start, end, period): what overlaps by a period or more is one run."""
    if not len(found):
        return found
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 3], found[:, 0]))]
    out = [found[0].tolist()]
    for doc, start, end, period in found[1:].tolist():
        last = out[-1]
        if (doc, period) == (last[0], last[3]) and start + period <= last[2]:
            last[2] = max(last[2], end)
        else:
            out.append([doc, start, end, period])
    merged = np.array(out, np.int64)
    return merged[np.lexsort((merged[:, 3], merged[:, 1], merged[:, 0]))]


def find_runs(ids: np.ndarray, doc: np.ndarray, terminals: int) -> np.ndarray:
    """Rows (text, start, end, period) of all runs of several texts, places counted over all of them."""
    if len(ids) < LEAST_WORDS:
        return np.zeros((0, 4), np.int64)
    grammar = build(ids, doc, terminals)
    rules = np.flatnonzero(grammar.size >= LEAST_WORDS)
    low = grammar.place[rules]
    middle, high = low + grammar.size[grammar.left[rules]], low + grammar.size[rules]
    own = crossing(ids, *neighbours_of(ids, doc), low, middle, high)
    own[:, 1:3] -= low[own[:, 0], None]
    own[:, 0] = rules[own[:, 0]]
    return merge(translate(grammar, own)) if len(own) else own


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, int]:
    """Numbers of the words of several texts, and how many there are."""
    words = list(chain.from_iterable(texts))
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), len(known)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Place of the word that stands at each place, where the id says that the text turns periodic."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def _measure(batches: Iterator[pa.RecordBatch], names: list[str], change) -> Iterator[pa.RecordBatch]:
    """Per row: its runs (start, length, period) and its words without the repeats, as bytes."""
    for batch in batches:
        texts = utf8(batch.column(0))
        keys = batch.column(1).to_pylist()
        runs, kept = [], []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < BATCH_WORDS):
                words = (texts[at] or b"").split()
                where = change(keys[at], len(words)) if change else None
                group.append(words if where is None else [words[i] for i in where.tolist()])
                size += len(words)
                at += 1
            for words, mine in zip(group, runs_of(group), strict=True):
                runs.append(mine)
                if mine:
                    drop = np.zeros(len(words), bool)
                    for start, length, period in mine:
                        drop[start + period : start + length] = True
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                kept.append(b" ".join(words))
        listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in mine] for mine in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], listed, pa.array(kept, pa.binary()).cast(pa.string())], names=names)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period."""
    ids, terminals = word_ids(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for doc, start, end, period in find_runs(ids, np.repeat(np.arange(len(texts)), sizes), terminals).tolist():
        out[doc].append((start - int(first[doc]), end - start, period))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", change=None) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` with the periodic runs of each text, and the text without their repeats.

    Words are what stands between white space (U+0020, U+0009 to U+000D). A run is a stretch of
    ``LEAST_WORDS`` words or more, at least three times its smallest period, that no neighbouring
    word extends. Runs come by start, then period. ``change(key, n)`` may give the place of the word
    that stands at each of n places. Null and empty texts have no words; rows are independent, so
    repeated rows repeat their result and an empty table stays empty. A text is the work of one
    task; its grammar takes memory in proportion to it. The added columns get names that clash
    with none, returned as the second value: runs, collapsed.
    """
    new = {}
    for base in ("runs", "collapsed"):
        new[base] = fresh([*docs.columns, *new.values()], base)
    run = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([*docs.schema.fields, T.StructField(new["runs"], run), T.StructField(new["collapsed"], T.StringType())])
    names = schema.names
    front = [F.col(text).alias(fresh(docs.columns, "text_")), F.col(key).alias(fresh(docs.columns, "key_"))]
    return map_batches(docs.select(*front, *docs.columns), lambda it: _measure(it, names, change), schema), new


def digests(docs: DataFrame, change=None) -> DataFrame:
    """Per row of (doc_id, text): number of runs, the one with most periods, and digests of all runs and of the collapsed text."""
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measure(batches, ["doc_id", "runs", "collapsed"], change):
            out = []
            for mine, kept in zip(batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                runs = [(r["start"], r["length"], r["period"]) for r in mine]
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                out.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([row[i] for row in out], pa.int64() if i < 5 else pa.string()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in longs), *(T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256"))])
    names = schema.names
    return map_batches(rows.select("text", F.col("doc_id").alias("key"), "doc_id"), work, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: number of runs, the best one, digests of all runs and of the text without repeats."""
    return digests(table(spark, sf_dir, "documents"), planted)
