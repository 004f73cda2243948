"""Spelling variants: words one edit apart, found by dense prefix and suffix tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import map_batches, stage, table
from docloom.operators.skew import salted_join

#: Maximal runs of letters; shorter ones cannot give a word, as an edit only deletes.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_POINTS = 7
LEAST_COUNT = 2
RATIO = 10
#: A word has this many holes; an edit lies in one of them, and what is around the hole is the key.
HOLES = 3
BLOCK_ROWS = 2048
BLOCK_POINTS = 1 << 22
CHUNK_ROWS = 1 << 16
SMALL_CELL = 48
LONG_WORD = 250


def word_counts(docs: DataFrame, word: Column | None = None, text: str = "text", least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of ``least_points`` code points or more that occur ``least_count`` times or more.

    A word is a maximal run of Latin letters, A-Z in lower case; ``word`` may change it, as an
    expression over the columns of ``docs`` and ``_run``. Null texts have no words. Counts are
    added up in every task before they meet, so a word of a third of all rows is one row per task.
    """
    runs = docs.withColumn("_run", F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN % least_points), F.lit(0))))
    runs = runs.withColumn("_run", F.translate("_run", UPPER, LOWER))
    words = runs.select((F.col("_run") if word is None else word).alias("word")).where(F.length("word") >= least_points)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def cuts(length: int) -> list[int]:
    """Borders of the holes of a pair whose longer word has ``length`` code points."""
    return [length * i // HOLES for i in range(HOLES + 1)]


def cells(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each word in every cell where it can meet a near one: (points, hole, cell, a, b, side, word, n).

    A pair belongs to the length of its longer word, so a word stands in two lengths. Per length
    and hole, the code points before and after the hole are the key: two words one edit apart
    agree in one of them. A key with more than ``block_rows`` words is cut into blocks by hash,
    and its cells are pairs of blocks (a, b), so no cell outgrows a task.
    """
    size = F.col("points")
    border = lambda i: F.floor(size * i / HOLES).cast("int")
    long_as = F.explode(F.array(F.length("word"), F.length("word") + 1))
    holes = F.explode(F.array([F.struct(F.lit(i).alias("hole"), border(i).alias("x"), (size - border(i + 1)).alias("y")) for i in range(HOLES)]))
    keyed = words.select("word", "n", long_as.alias("points")).select("*", holes.alias("h")).select("word", "n", "points", "h.*")
    ending = F.when(F.col("y") > 0, F.substring("word", F.length("word") - F.col("y") + 1, F.col("y"))).otherwise("")
    key = F.xxhash64("points", "hole", F.substring(F.col("word"), F.lit(1), F.col("x")), ending)
    keyed = keyed.select("points", "hole", key.alias("cell"), "word", "n")
    most = F.greatest(F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_POINTS) / F.col("points"))), F.lit(1))
    crowded = keyed.groupBy("points", "hole", "cell").agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    crowded = crowded.select("points", "hole", "cell", F.ceil(F.col("_rows") / most).cast("int").alias("_blocks"))
    spread = salted_join(keyed, crowded, ["points", "hole", "cell"], "left", spread_by=["word"])
    mine = F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int")
    met = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = spread.withColumn("_mine", F.coalesce(mine, F.lit(0))).withColumn("_met", met)
    a, b = F.least("_mine", "_met"), F.greatest("_mine", "_met")
    return out.select("points", "hole", "cell", a.alias("a"), b.alias("b"), (F.col("_mine") != a).cast("int").alias("side"), "word", "n")


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one column per word, padded behind and padded in front."""
    code, zero, kind = ("latin-1", "\0", np.uint8) if max(map(max, words), default="") < "Ā" else ("utf-32-le", "\0", np.uint32)
    read = lambda padded: np.ascontiguousarray(np.frombuffer("".join(padded).encode(code, "surrogatepass" if kind is np.uint32 else "strict"), kind).reshape(len(words), width).T)
    return read([w.ljust(width, zero) for w in words]), read([w.rjust(width, zero) for w in words])


def common(front: np.ndarray, back: np.ndarray, left, right) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix and suffix length of every pair of two index sets that broadcast against each other."""
    out = []
    for points, order in ((front, range(len(front))), (back, range(len(back) - 1, -1, -1))):
        same = length = None
        for c in order:
            equal = points[c][left] == points[c][right]
            if same is None:
                same, length = equal, equal.astype(np.uint8)
                continue
            same &= equal
            if c % 4 == 0 and not same.any():
                break
            length += same
        out.append(length)
    return out[0], out[1]


def near_pairs(words: list[str], cell: np.ndarray, side: np.ndarray, split: np.ndarray, points: int, hole: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs one edit apart, in bounded pieces.

    ``cell`` numbers the cells of the words, in order; where ``split`` is set, the cell holds two
    blocks and only words of different ``side`` meet. A pair is given in its first hole only.
    """
    border = cuts(points)
    full = np.array([len(w) for w in words]) == points

    def wanted(i, j, p, s):
        fit = lambda h: (p >= border[h]) & (s >= points - border[h + 1])
        hit = (full[i] | full[j]) & (~split[i] | (side[i] != side[j])) & (p.astype(np.int64) + s >= points - 1) & fit(hole)
        for h in range(hole):
            hit &= ~fit(h)
        return hit

    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    if points > LONG_WORD:
        for at, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            for i in range(at, at + n):
                for j in range(i + 1, at + n):
                    p, s = ends(words[i], words[j])
                    if wanted(i, j, np.int64(p), np.int64(s)):
                        yield np.array([i]), np.array([j])
        return
    front, back = matrices(words, points)
    small = (sizes <= SMALL_CELL) & (sizes > 1)
    if small.any():
        order = np.flatnonzero(small)[np.argsort(-sizes[small], kind="stable")]
        n = sizes[order]
        place = np.repeat(starts[order] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        number, f, b = np.repeat(np.arange(len(n)), n), front[:, place], back[:, place]
        for d in range(1, int(n[0])):
            rows = int(n[n > d].sum())
            p, s = common(f, b, slice(0, rows - d), slice(d, rows))
            i, j = place[: rows - d], place[d:rows]
            hit = (number[: rows - d] == number[d:rows]) & wanted(i, j, p, s)
            yield i[hit], j[hit]
    for at, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        f, b = front[:, at : at + n], back[:, at : at + n]
        step = max(1, (1 << 20) // n)
        for row in range(0, n, step):
            i, j = np.arange(row, min(row + step, n)), np.arange(row, n)
            p, s = common(f, b, (slice(row, row + step), None), (None, slice(row, n)))
            hit = wanted(at + i[:, None], at + j[None, :], p, s) & (i[:, None] < j[None, :])
            x, y = np.nonzero(hit)
            yield at + i[x], at + j[y]


def ends(a: str, b: str) -> tuple[int, int]:
    """Common prefix and suffix length of two long words."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in (a, b))
    first = lambda apart: int(apart.argmax()) if apart.any() else n
    return first(x[:n] != y[:n]), first(x[::-1][:n] != y[::-1][:n])


def _compare(batches: Iterator[pa.RecordBatch], ratio: int) -> Iterator[pa.RecordBatch]:
    """Per word and chunk of cells: near words, and the most frequent one that is frequent enough."""
    for rows in _chunks(batches):
        keys = [rows.column(c).to_numpy() for c in ("points", "hole", "cell", "a", "b")]
        words, counts, side = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("side").to_numpy()
        cell = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(words) > 1 else np.zeros(len(words), np.int64)
        split = keys[3] != keys[4]
        borders = [0, *(np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1).tolist(), len(words)]
        found, best = np.zeros(len(words), np.int64), {}
        for lo, hi in zip(borders, borders[1:], strict=False):
            for i, j in near_pairs(words[lo:hi], cell[lo:hi], side[lo:hi], split[lo:hi], int(keys[0][lo]), int(keys[1][lo])):
                i, j = i + lo, j + lo
                found += np.bincount(i, minlength=len(words)) + np.bincount(j, minlength=len(words))
                for low, high in ((i, j), (j, i)):
                    enough = counts[high] >= ratio * counts[low]
                    for x, y in zip(low[enough].tolist(), high[enough].tolist(), strict=True):
                        seen = (-int(counts[y]), words[y])
                        if x not in best or seen < best[x]:
                            best[x] = seen
        at = np.flatnonzero(found).tolist()
        picked = [best.get(x) for x in at]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[x] for x in at], pa.string()), pa.array(found[at], pa.int64()),
                pa.array([b and -b[0] for b in picked], pa.int64()), pa.array([b and b[1] for b in picked], pa.string()),
            ],
            names=["word", "n_near", "form_n", "form"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in chunks that end where a cell ends."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < CHUNK_ROWS and size < 4 * BLOCK_POINTS:
            continue
        whole = pa.Table.from_batches(held)
        last = {c: whole.column(c)[-1].as_py() for c in ("points", "hole", "cell", "a", "b")}
        open_ = np.ones(whole.num_rows, bool)
        for c, v in last.items():
            open_ &= whole.column(c).to_numpy() == v
        cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        rows, size = whole.num_rows - cut, sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame, ratio: int = RATIO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n_near, form, form_n) of the words of (word, n) that have a word exactly one edit away.

    An edit inserts, deletes or replaces one code point. The form is the near word of largest n
    (ties: smallest by code points) with at least ``ratio`` times the word's own n, else null.
    """
    dealt = cells(words, block_rows).repartition("points", "hole", "cell", "a", "b").sortWithinPartitions("points", "hole", "cell", "a", "b")
    parts = map_batches(dealt, lambda it: _compare(it, ratio), "word string, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f"))))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.f").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form from each word that has one.

    Each form is ``RATIO`` times as frequent as its word, so chains are short and never close;
    every round doubles how far a word sees, until nothing moves.
    """
    seen = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = seen.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(seen.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        seen = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return seen


def variants(words: DataFrame, ratio: int = RATIO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n).

    Words are distinct, as :func:`word_counts` gives them. A word without a near one has n_near 0,
    one without a frequent near one is its own root and has null form and form_n. An empty
    table gives an empty result; other columns of ``words`` are left out.
    """
    words = stage(words.select("word", "n"), "words")
    near = stage(near_words(words, ratio, block_rows), "near")
    last = roots(near.where(F.col("form").isNotNull()))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def planted(doc_id: str = "doc_id") -> Column:
    """The run without one code point where its document and itself say so; a null id counts as the empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col("_run")).cast("binary"))
    at = F.pmod(h, F.length("_run")).cast("int")
    less = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    return F.when(F.pmod(h, F.lit(31)) == 0, less).otherwise(F.col("_run"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of the documents: form, root, n, number of near words, n of the form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(word_counts(docs, planted()))
