"""Language ID: script ranges narrow the candidates, Viterbi labels the words of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fields, fresh, id_remainder, map_batches, stage, table
from docloom.operators.skew import top_k

#: The most labelled texts per language that the model is fitted on.
ROWS_PER_LANGUAGE = 1500
SLOT_BITS = 16
SMOOTHING = 0.5
#: What a change of language costs, in units of log probability; each byte's grams overlap, so they count half.
SWITCH = 12.0
GRAM_WEIGHT = 0.5
#: A language is a candidate for a script that at least this share of its words is written in.
LEAST_SHARE = 0.01
#: Characters whose grams are looked up at once, and of texts that are labelled together.
PIECE_CHARS = 1 << 18
BATCH_CHARS = 8 << 20
ROWS = 2500
IMPOSSIBLE = -1e4

#: First code points of the script ranges, in order; a range ends where the next begins.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
RANGE_SCRIPTS = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """The words of a run of texts: runs of letters, with what their scores need."""

    slots: np.ndarray
    first: np.ndarray
    size: np.ndarray
    script: np.ndarray
    text: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words of lower-cased texts; every character from U+0080 on counts as a letter here."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b"   ", dtype=np.uint8)
    letter = LETTER[raw]
    data = np.where(letter, raw, 32).astype(np.uint64)
    at = np.nonzero(letter)[0]
    three = data[at - 1] << np.uint64(16) | data[at] << np.uint64(8) | data[at + 1]
    four = three << np.uint64(8) | data[at + 2]
    shift = np.uint64(64 - SLOT_BITS)
    slots = np.stack([(three * np.uint64(0x9E3779B97F4A7C15)) >> shift, ((four * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift) + np.uint64(1 << SLOT_BITS)], axis=1).astype(np.int64)
    first = np.nonzero(np.diff(at, prepend=-9) != 1)[0]
    begin = at[first]
    b0, b1, b2, b3 = (data[np.minimum(begin + i, len(data) - 1)].astype(np.int64) for i in range(4))
    point = np.select(
        [b0 < 0x80, b0 < 0xE0, b0 < 0xF0],
        [b0, (b0 & 31) << 6 | b1 & 63, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63],
        (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63,
    )
    script = RANGE_SCRIPTS[np.searchsorted(RANGE_STARTS, point, side="right") - 1]
    starts = 1 + np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]]) if parts else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(first, len(at)))
    return Words(slots, first, size, script, np.searchsorted(starts, begin, side="right") - 1)


@dataclass
class Model:
    """Log probabilities of the grams in each language, and the languages that use each script."""

    languages: list[str]
    grams: np.ndarray
    allowed: np.ndarray
    common: int

    def scores(self, words: Words) -> np.ndarray:
        """Per-word score of each language; only candidates of the word's script have one, words without any score 0."""
        if not len(words.first):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        each = self.grams[words.slots[:, 0]] + self.grams[words.slots[:, 1]]
        out = np.add.reduceat(each, words.first, axis=0) * np.float32(GRAM_WEIGHT)
        allowed = self.allowed[words.script]
        out[~allowed] = IMPOSSIBLE
        out[~allowed.any(axis=1)] = 0
        return out


def viterbi(scores: np.ndarray, begins: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; texts hold ``counts`` words from ``begins`` on and all go forward together.

    A text's best labelling adds its words' scores and pays ``switch`` for every change.
    """
    width = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    came = np.zeros((len(scores), width), dtype=np.int16)
    labels = np.zeros(len(scores), dtype=np.int16)
    longest = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")
    held = np.zeros((len(counts), width), dtype=np.float64)
    own = np.arange(width, dtype=np.int16)
    for step in range(longest):
        k = alive[step]
        at = begins[:k] + step
        now = held[:k]
        if step:
            best = now.argmax(axis=1)
            change = now[np.arange(k), best] - switch
            moved = now < change[:, None]
            came[at] = np.where(moved, best[:, None].astype(np.int16), own)
            now = np.where(moved, change[:, None], now)
        held[:k] = now + scores[at]
    state = held.argmax(axis=1) if len(counts) else np.zeros(0, dtype=np.int64)
    for step in range(longest - 1, -1, -1):
        k = alive[step]
        at = begins[:k] + step
        labels[at] = state[:k]
        if step:
            state[:k] = came[at, state[:k]]
    return labels


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on at most ``rows`` different texts of each language, those with the smallest hashes; copies count once, null texts and labels not."""
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("hash", F.xxhash64("text"))
    # The hashes alone say how far the sample reaches; texts beyond are never shuffled.
    reach = top_k(known.select("lang", "hash").distinct(), ["lang"], [F.asc("hash")], rows).groupBy("lang").agg(F.max("hash").alias("reach"))
    near = known.join(F.broadcast(reach), "lang").where(F.col("hash") <= F.col("reach"))  # one row per language
    sample = stage(near.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text"), "labelled")

    def count(rows_):
        langs = rows_.column("lang")
        grams, scripts = np.zeros(2 << SLOT_BITS, dtype=np.int64), np.zeros(len(SCRIPTS), dtype=np.int64)
        texts = rows_.column("text").to_pylist()
        for at in range(0, len(texts), 64):
            words = words_of(texts[at : at + 64])
            grams += np.bincount(words.slots.ravel(), minlength=2 << SLOT_BITS)
            scripts += np.bincount(words.script, minlength=len(SCRIPTS))
        return pa.table({"lang": langs[:1], "texts": pa.array([len(texts)], pa.int64()), "grams": pa.array([grams.tobytes()], pa.binary()), "scripts": pa.array([scripts.tobytes()], pa.binary())})

    found = sorted(sample.groupBy("lang").applyInArrow(count, "lang string, texts long, grams binary, scripts binary").collect(), key=lambda r: r["lang"])  # one row per language
    languages = [r["lang"] for r in found]
    grams = np.array([np.frombuffer(r["grams"], dtype=np.int64) for r in found], dtype=np.float64).reshape(len(found), 2, 1 << SLOT_BITS)
    scripts = np.array([np.frombuffer(r["scripts"], dtype=np.int64) for r in found], dtype=np.float64).reshape(len(found), len(SCRIPTS))
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=2, keepdims=True) + SMOOTHING * (1 << SLOT_BITS)))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    common = max(range(len(found)), key=lambda i: found[i]["texts"], default=0)
    return Model(languages, np.ascontiguousarray(logs.reshape(len(found), 2 << SLOT_BITS).T.astype(np.float32)), (share >= LEAST_SHARE).T.copy(), common)


def _judge(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) of each text, some of them at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < BATCH_CHARS or stop == at):
            size += len(texts[stop] or "")
            stop += 1
        yield from _judge_some(model, texts[at:stop])
        at = stop


def _judge_some(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
    scores, numbers, sizes = [], [], []
    at = 0
    while at < len(texts) and model.languages:
        stop, size = at, 0
        while stop < len(texts) and (size < PIECE_CHARS or stop == at):
            size += len(texts[stop] or "")
            stop += 1
        words = words_of([t or "" for t in texts[at:stop]])
        scores.append(model.scores(words))
        numbers.append((words.text + at).astype(np.int32))
        sizes.append(words.size.astype(np.int32))
        at = stop
    width = len(model.languages)
    number = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
    size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    begins = np.searchsorted(number, np.arange(len(texts)))
    counts = np.searchsorted(number, np.arange(len(texts)), side="right") - begins
    labels = viterbi(np.concatenate(scores), begins, counts) if scores else np.zeros(0, dtype=np.int16)
    weight = np.bincount(number.astype(np.int64) * max(width, 1) + labels, size, len(texts) * max(width, 1)).reshape(len(texts), -1)
    for i, text in enumerate(texts):
        if not width or text is None or not (any(map(str.isalpha, text)) if counts[i] else False):
            yield "und", 0.0, []
            continue
        mine = labels[begins[i] : begins[i] + counts[i]]
        cut = np.concatenate([[0], np.nonzero(np.diff(mine))[0] + 1, [len(mine)]])
        spans = [(model.languages[mine[a]], int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        best = int(weight[i].argmax())
        yield model.languages[best], float(weight[i, best] / weight[i].sum()), spans


def label(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with language, score and spans of each whole text.

    A span is a run of words (letters, numbered from 0) of one language. The language is that of
    the most bytes of words, the score its share of them. Null texts and texts without a letter
    are ``und`` with score 0 and no spans, as is everything if nothing was learned. Only the text
    is an input; repeated rows repeat their result; an empty table stays empty. Added columns get
    names that clash with none and come back as the second value.
    """
    new: dict[str, str] = {}
    for base in ("language", "score", "spans"):
        new[base] = fresh([*docs.columns, *new.values()], base)
    kind = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema, at = fields(docs.schema, (new["language"], T.StringType()), (new["score"], T.DoubleType()), (new["spans"], kind)), docs.columns.index(text)
    names = schema.names
    arrow = pa.list_(pa.struct([("language", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                found = list(_judge(model, part.column(at).to_pylist()))
                spans = pa.array([[{"language": n, "start": a, "stop": b} for n, a, b in f[2]] for f in found], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=names)

    return map_batches(docs, work, schema), new


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held_out, lang_pred, score, and the number of spans."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_remainder("doc_id", 4) != 2))
    rows, new = label(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), F.col(new["language"]).alias("lang_pred"), F.col(new["score"]).alias("score"), F.size(new["spans"]).alias("n_spans")
    )
