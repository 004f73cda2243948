"""Token counts by distinct pre-token, without making ids."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import first_row_id, fresh, join_groups, map_batches, stage, table, utf8

#: Pre-tokens of a byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that newer tables of letters, digits and spaces class otherwise; texts with one are split by the library.
UNSURE = "[\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7f1\U0000ab6c-\U0000ab6d\U00010000-\U0001f2ff\U0001fb00-\U0010ffff]"
LIMIT = 1024
#: The frequent pre-tokens every task holds: from about so many documents, at most so many, of at most so many code points.
SAMPLE_DOCS = 4096
SHIPPED = 1 << 16
SHIPPED_POINTS = 64
FOLDED = 1 << 19


class Splitter:
    """Pre-tokens of a text and number of tokens of a pre-token, as a vocabulary file has them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = (spec["normalizer"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"].get("use_regex", True), spec["pre_tokenizer"]["add_prefix_space"])
        if kinds != (None, "ByteLevel", True, False):
            raise ValueError(f"{path} is no byte-level vocabulary without a normaliser")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.split, self.unsure = regex.compile(SPLIT).findall, regex.compile(UNSURE).search

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of what lies between special strings, and the number of those strings."""
        if not any(s in text for s in self.special):
            return self._pieces(text), 0
        parts = self.cut(text)
        return [p for part in parts for p in self._pieces(part)], len(parts) - 1

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or not self.unsure(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.by_library(text)]

    def by_library(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.library.pre_tokenizer.pre_tokenize_str(text)

    def sizes(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each pre-token."""
        return [len(e) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """One per worker process."""
    return Splitter(path)


def _pairs(found: dict[str, int], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=list(names))


def frequencies(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(piece, freq): how often each pre-token stands in all texts, added up in every task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = splitter(path).pretokens, Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(split(value.as_py() or "")[0])
                if len(found) > FOLDED:
                    yield _pairs(found, ("piece", "freq"))
                    found.clear()
        yield _pairs(found, ("piece", "freq"))

    return map_batches(docs.select(text), work, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))


def piece_sizes(pieces: DataFrame, path: str) -> DataFrame:
    """``pieces`` of distinct rows (piece, freq) with the number of tokens of each, encoded once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = splitter(path).sizes
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes(batch.column(0).to_pylist()), pa.int64())], names=["piece", "freq", "size"])

    return map_batches(pieces.select("piece", "freq"), work, "piece string, freq long, size long")


def frequent_sizes(docs: DataFrame, path: str, text: str = "text", sample_docs: int = SAMPLE_DOCS, shipped: int = SHIPPED) -> dict[str, int]:
    """Sizes of the most frequent pre-tokens of a bounded sample, at most ``shipped``; they never change a result."""
    rows = docs.count()
    sample = docs.sample(min(1.0, sample_docs / rows), seed=1) if rows else docs
    known = frequencies(sample, path, text).where(F.length("piece") <= SHIPPED_POINTS).orderBy(F.col("freq").desc(), "piece").limit(shipped)
    return {r.piece: r.size for r in piece_sizes(known, path).collect()}  # ``shipped`` rows at most


def _measure(batches: Iterator[pa.RecordBatch], path: str, known: dict[str, int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Per text: bytes, tokens of the pre-tokens in ``known``, and the frequencies of all others."""
    split, row = splitter(path).pretokens, first_row_id()
    size = known.get
    for batch in batches:
        sums, starts, pieces, freqs = [], [0], [], []
        lengths = [len(t or b"") for t in utf8(batch.column(0))]
        for value in batch.column(0):
            found, total = split(value.as_py() or "")
            for piece, freq in Counter(found).items():
                tokens = size(piece)
                if tokens is None:
                    pieces.append(piece)
                    freqs.append(freq)
                else:
                    total += tokens * freq
            sums.append(total)
            starts.append(len(pieces))
        rest = pa.ListArray.from_arrays(
            pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(freqs, pa.int64())], names=["piece", "freq"])
        )
        rows = pa.array(range(row, row + len(sums)), pa.int64())
        row += len(sums)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows, pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), rest], names=names)


def token_counts(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", limit: int = LIMIT, sample_docs: int = SAMPLE_DOCS, shipped: int = SHIPPED
) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` of every row of ``docs`` with its bytes in UTF-8, tokens, and whether these are over ``limit``.

    The vocabulary file is byte-level, without normaliser; strings of its special tokens count as
    one token each, as the library has it. Null and empty texts have no bytes and no tokens; rows
    are independent, so repeated rows repeat their counts and an empty table stays empty. The
    added columns get names that clash with none, returned as the second value: n_bytes,
    n_tokens, over_limit.

    A text is split once. Frequent pre-tokens, a bounded table, are summed up in the task; the
    frequencies of all others are shuffled by pre-token, each distinct one is encoded once, and
    the sums go back by row. A pre-token of more than a thousandth of those rows is salted.
    """
    new = {}
    for base in ("n_bytes", "n_tokens", "over_limit", "row", "known", "rest"):
        new[base] = fresh([*keep, *new.values()], base)
    known = frequent_sizes(docs, path, text, sample_docs, shipped)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rest = T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("freq", T.LongType())]))
    more = [(new["row"], T.LongType()), (new["n_bytes"], T.LongType()), (new["known"], T.LongType()), (new["rest"], rest)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in more)])
    names = schema.names
    measured = map_batches(docs.select(F.col(text).alias(fresh(keep, "text")), *keep), lambda it: _measure(it, path, shared.value, names), schema)
    rows = stage(measured, "measured")
    open_ = rows.select(F.col(new["row"]).alias("row"), F.explode(new["rest"]).alias("p")).select("row", "p.piece", "p.freq")
    distinct = stage(piece_sizes(open_.groupBy("piece").agg(F.sum("freq").alias("freq")), path), "sizes")
    total = distinct.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    joined = join_groups(open_.withColumnRenamed("freq", "mine"), distinct, "piece", "freq", total, "row")
    sums = joined.groupBy(F.col("row").alias(new["row"])).agg(F.sum(F.col("mine") * F.col("size")).alias(new["rest"]))
    out = rows.drop(new["rest"]).join(sums, new["row"], "left")
    tokens = F.col(new["known"]) + F.coalesce(new["rest"], F.lit(0))
    out = out.select(*keep, new["n_bytes"], tokens.alias(new["n_tokens"]), (tokens > limit).alias(new["over_limit"]))
    return out, {k: new[k] for k in ("n_bytes", "n_tokens", "over_limit")}


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, tokens, and whether these are more than 1,024."""
    return token_counts(table(spark, sf_dir, "documents"), public_path())[0]
