"""Licence scan: notice phrases by Aho-Corasick, licence expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fields, fresh, map_batches, table

#: Phrases whose places count as base hits, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels, with the weight of one such notice.
NOTICE_PHRASES = {
    "apache license": ("apache-2.0", 0.8),
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl-2.0", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "isc license": ("isc", 0.7),
    "public domain": ("public-domain", 0.5),
    "creative commons": ("creative-commons", 0.6),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.7),
    "copyright": ("copyright", 0.4),
    "licensed under": ("licensed", 0.4),
    "license agreement": ("agreement", 0.4),
}
BASE_WEIGHT = 0.7
TAG_WEIGHT = 0.95
TAG = "spdx license identifier"
#: Families that may be used freely; a name belongs to a family when it starts with it.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "cc0", "cc-by-4", "cc-by-3", "unlicense", "0bsd", "bsl", "python", "postgresql")
#: Copyright exceptions that turn a share-alike licence into one that may be linked freely.
LINKING = ("classpath-exception", "gcc-exception", "llvm-exception", "linking-exception")

WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
PARTS = re.compile(r"\(|\)|[a-z0-9.+:_-]+")
BINDS = {"or": 1, "and": 2, "with": 3}

HIT = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("base", T.BooleanType())]))
EXPRESSION = T.ArrayType(T.StructType([T.StructField("postfix", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("permissive", T.BooleanType())]))


def to_postfix(text: str) -> list[str]:
    """Shunting yard: the longest sound start of a licence expression, in postfix order.

    ``with`` binds closest, then ``and``, then ``or``; a line may go on after the expression, so
    reading stops where neither an operator nor a bracket can stand. An unsound one gives [].
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    for part in PARTS.findall(text):
        if operand and part == "(":
            held.append(part)
        elif operand and part not in BINDS and part != ")":
            out.append(part)
            operand = False
        elif not operand and part == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif not operand and part in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[part]:
                out.append(held.pop())
            held.append(part)
            operand = True
        else:
            break
    if operand or "(" in held:
        return []
    return out + held[::-1]


def evaluate(postfix: list[str]) -> bool | None:
    """Whether some choice the expression allows is permissive throughout; None if there is nothing to rate."""
    stack: list[tuple[bool, str]] = []
    for part in postfix:
        if part not in BINDS:
            stack.append((part.startswith(PERMISSIVE), part))
            continue
        (b, extra), (a, name) = stack.pop(), stack.pop()
        if part == "with":
            stack.append((a or extra.startswith(LINKING), name))
        else:
            stack.append(((a or b) if part == "or" else (a and b), name))
    return stack[0][0] if stack else None


def licence_names(postfix: list[str]) -> list[str]:
    """Licences an expression names, without the exceptions."""
    names, stack = [], []
    for part in postfix:
        if part not in BINDS:
            stack.append([part])
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a if part == "with" else a + b)
    for x in stack:
        names += x
    return sorted(set(names))


@lru_cache(maxsize=1)
def notice_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (label, len(phrase) + 2, phrase.count(" ") + 1, BASE_WEIGHT, True))
    for phrase, (label, weight) in NOTICE_PHRASES.items():
        found.add_word(f" {phrase} ", (label, len(phrase) + 2, phrase.count(" ") + 1, weight, False))
    found.add_word(f" {TAG} ", ("spdx", len(TAG) + 2, 3, 0.0, False))
    found.make_automaton()
    return found


def scan_text(text: bytes | None) -> tuple[int, list[tuple[str, int, int, bool]], list[tuple[str, list[str], bool]], float]:
    """(words, hits, expressions, score) of one whole text."""
    low = (text or b"").lower()
    words = low.translate(WORD_BYTES).split()
    line = b" " + b" ".join(words) + b" "
    hits, doubt, tagged, seen = [], 1.0, False, set()
    at = place = 0
    for end, (label, size, count, weight, base) in notice_automaton().iter(line.decode("latin-1")):
        start = end + 1 - size
        place = place + line.count(b" ", at, start) if start >= at else line.count(b" ", 0, start)
        at = start
        if label == "spdx":
            tagged = True
            continue
        hits.append((label, place, count, base))
        if label not in seen:
            seen.add(label)
            doubt *= 1 - weight
    expressions = []
    if tagged:
        for found in TAG_LINE.findall(low):
            if postfix := to_postfix(found.decode("utf-8", "replace")):
                expressions.append((" ".join(postfix), licence_names(postfix), bool(evaluate(postfix))))
        if expressions:
            doubt *= 1 - TAG_WEIGHT
    return len(words), hits, expressions, 1 - doubt


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n_words, licence hits, licence expressions and a score of 0 to 1 for each whole text.

    A-Z count as lower case; words are runs of digits, letters a-z and characters from U+0080 on.
    A hit stands where all words of a phrase follow each other: its label, the number of its first
    word from 0, its length, and whether the phrase is a base one; hits may overlap and all are
    listed. The score is one minus the product of (1 - weight) over distinct labels and a parsed
    expression. Null and empty texts have no words, no hits and score 0. Rows are independent, so
    repeated rows repeat their result and an empty table stays empty. Added columns get names that
    clash with none; they come back as the second value.
    """
    new: dict[str, str] = {}
    for base in ("n_words", "hits", "expressions", "score"):
        new[base] = fresh([*docs.columns, *new.values()], base)
    at = docs.columns.index(text)
    schema = fields(docs.schema, (new["n_words"], T.LongType()), (new["hits"], HIT), (new["expressions"], EXPRESSION), (new["score"], T.DoubleType()))
    names = schema.names
    hit_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int32()), ("base", pa.bool_())]))
    expression_type = pa.list_(pa.struct([("postfix", pa.string()), ("names", pa.list_(pa.string())), ("permissive", pa.bool_())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits, expressions, scores = [], [], [], []
            for value in batch.column(at).cast(pa.large_binary()):
                n, found, parsed, score = scan_text(value.as_py())
                counts.append(n)
                hits.append([{"label": a, "word": b, "words": c, "base": d} for a, b, c, d in found])
                expressions.append([{"postfix": a, "names": b, "permissive": c} for a, b, c in parsed])
                scores.append(score)
            more = [pa.array(counts, pa.int64()), pa.array(hits, hit_type), pa.array(expressions, expression_type), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return map_batches(docs, work, schema), new


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, base places, labels and score, from the hits of ``scan``."""
    rows, new = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(new["hits"], lambda h: h["base"])
    label = lambda hits: F.transform(hits, lambda h: h["label"])
    named = F.flatten(F.transform(new["expressions"], lambda e: e["names"]))
    return rows.select(
        "doc_id",
        F.col(new["n_words"]).alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["word"])).alias("last_word"),
        _joined(label(base)).alias("base_labels"),
        _joined(F.concat(label(F.col(new["hits"])), named)).alias("labels"),
        F.col(new["score"]).alias("score"),
        F.array_join(F.transform(new["expressions"], lambda e: e["postfix"]), ";").alias("expressions"),
    )
