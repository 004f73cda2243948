"""LM scoring: logistic mixing of hashed-context bit predictors, and a word baseline.

Documents are dealt into blocks by a hash. Each block sends its distinct words and byte windows
with their training counts, packed by owner; owners add them up over all blocks, fit the model on
their contexts, and send one number back for each word or window of a block. So what a task holds
is bounded by a block and by a share of the contexts, and grows with no hot word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import id_remainder, stage, table, utf8

BLOCK_BYTES = 16 << 20
PIECE_BYTES = 1 << 19
#: Bits of a byte's code and of a place where a window and its place are sorted as one number.
CODE_BITS = 7
PLACE_BITS = 20
#: Predictors look at this many bytes before, at all shorter contexts, and at none.
ORDERS = 5
#: Steps of the stretched probability in the refinement, and the weight of its starting value.
BUCKETS = 33
PRIOR = 20.0
EPOCHS = 3
RATE = 0.05
BATCH = 8192
END = b"\n"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or b"").lower().split()


def windows_of(lines: list[bytes], code: np.ndarray | None = None, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``ORDERS`` bytes before it as one number, and the number of bytes of each line.

    The byte is the lowest; the bytes before follow, the nearest first. A line starts after ends.
    With ``code``, bytes are replaced by codes of ``bits`` bits.
    """
    pad = END * ORDERS
    data = np.frombuffer(pad + pad.join(lines), dtype=np.uint8)
    data = (data if code is None else code[data]).astype(np.int64)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    n = len(data) - ORDERS
    found = data[ORDERS:].copy()
    for back in range(1, ORDERS + 1):
        found |= data[ORDERS - back : ORDERS - back + n] << (bits * back)
    own = np.ones(n, dtype=bool)  # without the ends that stand before each later line
    for gap in (np.cumsum(sizes + ORDERS) - ORDERS)[:-1].tolist():
        own[gap : gap + ORDERS] = False
    return found[own], sizes


def grouped_windows(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of lines, how often each occurs, the places of all of them in that order, and the lines' sizes.

    Where the lines have few different bytes, a window in short codes and its place fit in one
    number, and sorting numbers is much faster than ordering places.
    """
    alphabet = np.nonzero(np.bincount(np.frombuffer(END + b"".join(lines), dtype=np.uint8), minlength=256))[0]
    if len(alphabet) <= 1 << CODE_BITS and sum(map(len, lines)) <= 1 << PLACE_BITS:
        code = np.zeros(256, dtype=np.uint8)
        code[alphabet] = np.arange(len(alphabet))
        windows, sizes = windows_of(lines, code, CODE_BITS)
        both = np.sort(windows << PLACE_BITS | np.arange(len(windows)))
        coded, places = both >> PLACE_BITS, (both & ((1 << PLACE_BITS) - 1)).astype(np.int32)
        first = np.nonzero(np.diff(coded, prepend=-1))[0]
        short, found = coded[first], np.zeros(len(first), dtype=np.int64)
        for back in range(ORDERS + 1):
            found |= alphabet[short >> (CODE_BITS * back) & ((1 << CODE_BITS) - 1)].astype(np.int64) << (8 * back)
        return found, np.diff(np.append(first, len(coded))).astype(np.int32), places, sizes
    windows, sizes = windows_of(lines)
    places = np.argsort(windows)
    windows = windows[places]
    first = np.nonzero(np.diff(windows, prepend=-1))[0]
    return windows[first], np.diff(np.append(first, len(windows))), places.astype(np.int32), sizes


def line_of(words: list[bytes]) -> bytes:
    """What the byte model reads of a text: words, single spaces, one end."""
    return b" ".join(words) + END


def pieces_of(lines: list[bytes]) -> Iterator[list[bytes]]:
    """Lines in runs of bounded size."""
    first, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= PIECE_BYTES:
            yield lines[first : i + 1]
            first, size = i + 1, 0
    if first < len(lines):
        yield lines[first:]


def word_owner(word: bytes, owners: int) -> int:
    return xxhash.xxh32_intdigest(word) % owners


def window_owner(windows: np.ndarray, owners: int) -> np.ndarray:
    """By the two bytes before, so that an owner has all of a context of two or more bytes."""
    near = (windows >> 8) & 0xFFFF
    return ((near * 0x9E3779B1) >> 15) % owners


def _by_owner(words: set[bytes], owners: int) -> list[list[bytes]]:
    """Distinct words of a block by owner, in an order that they alone decide."""
    out: list[list[bytes]] = [[] for _ in range(owners)]
    for w in sorted(words):
        out[word_owner(w, owners)].append(w)
    return out


def _counted(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of lines, rising, and how often each occurs."""
    found = [np.unique(windows_of(piece)[0], return_counts=True) for piece in pieces_of(lines)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys, code = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return keys, np.bincount(code, np.concatenate([f[1] for f in found]), len(keys)).astype(np.int64)


def _cut_by_owner(keys: np.ndarray, owners: int) -> list[np.ndarray]:
    """Places of the windows of each owner, rising."""
    owner = window_owner(keys, owners)
    by = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by], np.arange(owners + 1))
    return [by[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _gather(owners: int):
    """A block's packed rows: (block, owner, words, their counts, windows, their counts)."""

    def work(docs):
        counts: Counter = Counter()
        seen: set[bytes] = set()
        learned, held = [], []
        for learn, text in zip(docs.column("learn").to_pylist(), utf8(docs.column("text").combine_chunks()), strict=True):
            words = words_of(text)
            (learned if learn else held).append(line_of(words))
            (counts if learn else seen).update(words)
        by_word = _by_owner(seen | counts.keys(), owners)
        known, number = _counted(learned)
        others = np.setdiff1d(_counted(held)[0], known, assume_unique=True)
        keys = np.concatenate([known, others])
        order = np.argsort(keys)
        keys, number = keys[order], np.concatenate([number, np.zeros(len(others), dtype=np.int64)])[order]
        places = _cut_by_owner(keys, owners)
        block = docs.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * owners, pa.int32()),
                "owner": pa.array(range(owners), pa.int32()),
                "words": pa.array([b"\n".join(w) for w in by_word], pa.binary()),
                "word_counts": pa.array([np.array([counts[x] for x in w], dtype="<i4").tobytes() for w in by_word], pa.binary()),
                "windows": pa.array([np.diff(keys[p], prepend=0).astype("<i8").tobytes() for p in places], pa.binary()),
                "window_counts": pa.array([number[p].astype("<i4").tobytes() for p in places], pa.binary()),
            }
        )

    return work


def _numbers(column) -> list[np.ndarray]:
    """Counts of each row."""
    return [np.frombuffer(x, dtype="<i4") for x in column.to_pylist()]


def _windows(column) -> list[np.ndarray]:
    """Windows of each row, which are sent in rising order as differences."""
    return [np.cumsum(np.frombuffer(x, dtype="<i8")) for x in column.to_pylist()]


def _count_words(rows):
    """An owner's answer to each block: the training count of each word it sent; and the owner's totals."""
    total: dict[bytes, int] = {}
    sent = [x.split(b"\n") if x else [] for x in rows.column("words").to_pylist()]
    for words, counts in zip(sent, _numbers(rows.column("word_counts")), strict=True):
        for w, c in zip(words, counts.tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    known = [c for c in total.values() if c]
    n = len(sent)
    return pa.table(
        {
            "block": rows.column("block"),
            "owner": rows.column("owner"),
            "counts": pa.array([np.array([total[w] for w in words], dtype="<i8").tobytes() for words in sent], pa.binary()),
            "tokens": pa.array([sum(known), *[0] * (n - 1)], pa.int64()),
            "distinct": pa.array([len(known), *[0] * (n - 1)], pa.int64()),
        }
    )


class Contexts:
    """An owner's windows with the bit counts of every order."""

    def __init__(self, rows, near: np.ndarray):
        parts = _windows(rows.column("windows"))
        self.sizes = [len(p) for p in parts]
        everything = np.concatenate(parts)
        self.windows, self.code = np.unique(everything, return_inverse=True)
        self.counts = np.bincount(self.code, np.concatenate(_numbers(rows.column("window_counts"))), len(self.windows))
        self.near = near

    def bits(self, chosen: np.ndarray, without: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bit number, bit, ones and all per order) for the chosen windows, highest bit first.

        ``without`` leaves one occurrence of the window itself out of the counts, as if it were new.
        """
        windows, n = self.windows, len(self.windows)
        byte = windows & 0xFF
        tables = []
        for order in range(ORDERS + 1):
            if order >= 2:  # the owner has all of these contexts
                context = (windows >> 8) & ((1 << (8 * order)) - 1)
                key = context << 8 | byte
                by = np.argsort(key, kind="stable")
                tables.append((key[by], self.counts[by], by))
        for j in range(8):
            bit = (byte >> (7 - j)) & 1
            ones, total = np.zeros((ORDERS + 1, n)), np.zeros((ORDERS + 1, n))
            prefix = byte >> (8 - j)
            for order in (0, 1):
                table_ = self.near.sum(axis=0)[None, :] if order == 0 else self.near
                row = np.zeros(n, dtype=np.int64) if order == 0 else (windows >> 8) & 0xFF
                nodes = table_.reshape(len(table_), 1 << j, -1).sum(axis=2)
                half = table_.reshape(len(table_), 1 << (j + 1), -1).sum(axis=2)
                total[order], ones[order] = nodes[row, prefix], half[row, prefix * 2 + 1]
            for order in range(2, ORDERS + 1):
                key, counts, by = tables[order - 2]
                for shift, out in ((8 - j, total), (7 - j, ones)):
                    node = key >> shift
                    new = np.concatenate([[True], node[1:] != node[:-1]]) if n else np.zeros(0, dtype=bool)
                    sums = np.add.reduceat(counts, np.nonzero(new)[0]) if n else counts
                    out[order, by] = sums[np.cumsum(new) - 1]
                own = ones[order].copy()
                ones[order] = np.where(bit == 1, own, total[order] - own)
            bit, ones, total = bit[chosen], ones[:, chosen], total[:, chosen]
            if without:
                ones, total = np.maximum(ones - bit, 0), np.maximum(total - 1, 0)
            yield j, bit, ones, total


def inputs_of(j: int, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of all orders, plain and scaled by what they have seen, and the set of weights.

    The set is chosen by the bit's number and the longest context that was seen before.
    """
    p = (ones + 0.2) / (total + 0.4)
    stretched = np.log(p / (1 - p))
    seen = np.log1p(total) / 8
    x = np.concatenate([stretched, stretched * seen, np.ones((1, total.shape[1]))])
    gate = np.maximum(np.arange(ORDERS + 1)[:, None] * (total > 0), 0).max(axis=0) + j * (ORDERS + 1)
    return x, gate


def start_weights() -> np.ndarray:
    weights = np.zeros((8 * (ORDERS + 1), 2 * (ORDERS + 1) + 1))
    weights[:, : ORDERS + 1] = 0.3
    return weights


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def learn_weights(contexts: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """Online gradient steps over the owner's training windows; (weights x mass, mass) of each set."""
    weights, mass = start_weights(), np.zeros(8 * (ORDERS + 1))
    chosen = np.nonzero(contexts.counts > 0)[0]
    chosen = chosen[np.argsort((contexts.windows[chosen] * 0x9E3779B1) & 0xFFFFFFFF, kind="stable")]
    size = contexts.counts[chosen]
    squares = np.full_like(weights, 1e-4)
    for j, bit, ones, total in contexts.bits(chosen, without=True):
        x, gate = inputs_of(j, ones, total)
        np.add.at(mass, gate, size)
        for _ in range(EPOCHS):
            for a in range(0, len(chosen), BATCH):
                xs, g, c = x[:, a : a + BATCH], gate[a : a + BATCH], size[a : a + BATCH]
                error = squash((weights[g].T * xs).sum(axis=0)) - bit[a : a + BATCH]
                held = np.bincount(g, c, len(weights))
                step = np.stack([np.bincount(g, error * c * row, len(weights)) for row in xs], axis=1) / np.maximum(held, 1)[:, None]
                squares += step**2
                weights -= RATE * step / np.sqrt(squares)
    return weights * mass[:, None], mass


def mixed(contexts: Contexts, weights: np.ndarray, chosen: np.ndarray, without: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for j, bit, ones, total in contexts.bits(chosen, without):
        x, gate = inputs_of(j, ones, total)
        yield j, bit, np.clip((weights[gate].T * x).sum(axis=0), -12, 12)


def _place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (z + 12) / 24 * (BUCKETS - 1)
    low = np.minimum(at.astype(np.int64), BUCKETS - 2)
    return low, at - low


def refinement(contexts: Contexts, weights: np.ndarray) -> np.ndarray:
    """Ones and all that followed each mixed prediction, by bit number and bucket."""
    out = np.zeros((2, 8, BUCKETS))
    chosen = np.nonzero(contexts.counts > 0)[0]
    for j, bit, z in mixed(contexts, weights, chosen, without=True):
        low, share = _place(z)
        for at, part in ((low, 1 - share), (low + 1, share)):
            c = contexts.counts[chosen] * part
            out[0, j] += np.bincount(at, c * bit, BUCKETS)
            out[1, j] += np.bincount(at, c, BUCKETS)
    return out


def costs(contexts: Contexts, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Log10 probability of each window's byte after the bytes before it."""
    start = squash(np.linspace(-12, 12, BUCKETS))
    curve = (refined[0] + PRIOR * start) / (refined[1] + PRIOR)
    out = np.zeros(len(contexts.windows))
    for j, bit, z in mixed(contexts, weights, np.arange(len(contexts.windows)), without=False):
        low, share = _place(z)
        p = 0.5 * squash(z) + 0.5 * (curve[j][low] * (1 - share) + curve[j][low + 1] * share)
        p = np.clip(p, 1e-7, 1 - 1e-7)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def _summed(rows: DataFrame, owner_work, size: int) -> np.ndarray:
    """Sum over all owners of an array of fixed ``size``."""

    def work(part):
        found = owner_work(part)
        at = np.nonzero(found)[0]
        return pa.table({"at": pa.array(at, pa.int32()), "value": pa.array(found[at], pa.float64())})

    out = np.zeros(size)
    for at, value in rows.groupBy("owner").applyInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value")).collect():  # size rows at most
        out[at] = value
    return out


def _near_counts(part) -> np.ndarray:
    """Counts of each byte after each byte, 2**16 numbers."""
    out = np.zeros(1 << 16)
    for windows, counts in zip(_windows(part.column("windows")), _numbers(part.column("window_counts")), strict=True):
        out += np.bincount(windows & 0xFFFF, counts, 1 << 16)
    return out


def _score(owners: int, tokens: int, distinct: int, ends: int):
    """A block of documents with the owners' answers."""

    def work(docs, answers):
        lines, distinct_words = [], set()
        for text in utf8(docs.column("text").combine_chunks()) if docs.num_rows else ():
            words = words_of(text)
            distinct_words.update(words)
            lines.append(line_of(words))
        learn = docs.column("learn").combine_chunks().to_numpy(zero_copy_only=False) if docs.num_rows else np.zeros(0, dtype=bool)
        given = {o: (c, b) for o, c, b in zip(*(answers.column(x).to_pylist() for x in ("owner", "counts", "costs")), strict=True)}
        by_word = _by_owner(distinct_words, owners)
        count = np.concatenate([np.frombuffer(given[o][0], dtype="<i8") for o in range(owners)]) if lines else np.zeros(0)
        number = {w: i for i, w in enumerate(w for words in by_word for w in words)}
        base = tokens + 0.1 * (distinct + 1)
        plain, last = np.log10((count + 0.1) / base), float(np.log10((ends + 0.1) / base))
        n, known, scores = np.zeros(len(lines), dtype=np.int64), np.zeros(len(lines), dtype=np.int64), np.zeros(len(lines))
        for i, line in enumerate(lines):
            words = line.split()
            at = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
            n[i], known[i], scores[i] = len(at) + 1, np.count_nonzero(count[at]) + (ends > 0), plain[at].sum() + last

        del number, by_word, distinct_words
        # Each piece is sorted once: for the block's distinct windows, and to hand their prices out again.
        sorted_pieces = [grouped_windows(piece) for piece in pieces_of(lines)]
        keys = np.unique(np.concatenate([p[0] for p in sorted_pieces])) if lines else np.zeros(0, dtype=np.int64)
        cost, model = np.zeros(len(keys)), []
        for o, places in enumerate(_cut_by_owner(keys, owners)):
            if len(places):
                cost[places] = np.frombuffer(given[o][1], dtype="<f4")
        for found, times, by, sizes in sorted_pieces:
            each = np.empty(len(by))
            each[by] = np.repeat(cost[np.searchsorted(keys, found)], times)
            model.append(np.add.reduceat(each, np.cumsum(sizes) - sizes))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array(~learn, pa.bool_()),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(n), pa.int64()),
                "base_score": pa.array(scores, pa.float64()),
                "score": pa.array(np.concatenate(model) if model else np.zeros(0), pa.float64()),
            }
        )

    return work


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held: int = 10) -> DataFrame:
    """Score all texts with a model of those whose crc32(id as text) modulo ``held`` is not 0.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). The base is a word model
    with 0.1 added to each count; the score is the log10 probability of the text's bytes (A-Z in
    lower case, words joined by single spaces, then an end). Each byte is predicted bit by bit from
    the counts of the contexts of 0 to ``ORDERS`` bytes; their stretched predictions are mixed by weights that are chosen
    by the bit and the longest known context and learned online, then refined by what followed
    such predictions. Counts, weights and refinement come from all training texts.

    Null counts as empty: one token, the end. A null id counts as the empty text. Repeated rows
    repeat their result. Without training texts every count is 0. Only these two columns are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (id_remainder(doc_id, held) != 0).alias("learn"))
    total, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("learn")).first()
    owners = int(total // BLOCK_BYTES) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.xxhash64("doc_id"), F.xxhash64("text")), F.lit(owners)).cast("int"))
    packed = rows.select("block", "learn", "text").groupBy("block").applyInArrow(
        _gather(owners), "block int, owner int, words binary, word_counts binary, windows binary, window_counts binary"
    )
    packed = stage(packed, "packed")
    counted = packed.select("block", "owner", "words", "word_counts").groupBy("owner").applyInArrow(_count_words, "block int, owner int, counts binary, tokens long, distinct long")
    counted = stage(counted, "counted")
    tokens, distinct = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    owned = packed.select("block", "owner", "windows", "window_counts")
    sets, width = start_weights().shape
    near = _summed(owned, _near_counts, 1 << 16).reshape(256, 256)
    found = _summed(owned, lambda part: np.concatenate([x.ravel() for x in learn_weights(Contexts(part, near))]), sets * (width + 1))
    mass = found[sets * width :]
    weights = np.where(mass[:, None] > 0, found[: sets * width].reshape(sets, width) / np.maximum(mass, 1e-9)[:, None], start_weights())
    refined = _summed(owned, lambda part: refinement(Contexts(part, near), weights).ravel(), 2 * 8 * BUCKETS).reshape(2, 8, BUCKETS)

    def priced(part):
        contexts = Contexts(part, near)
        each = costs(contexts, weights, refined)[contexts.code].astype("<f4")
        cut = np.cumsum([0, *contexts.sizes])
        return pa.table({"block": part.column("block"), "owner": part.column("owner"), "costs": pa.array([each[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    prices = owned.groupBy("owner").applyInArrow(priced, "block int, owner int, costs binary")
    answers = counted.select("block", "owner", "counts").join(prices, ["block", "owner"])
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    scores = _score(owners, int(tokens + ends), int(distinct + (ends > 0)), int(ends))
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scores, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: tokens, the word model's score and the byte model's score."""
    return score(table(spark, sf_dir, "documents"))
