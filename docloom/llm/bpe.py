"""BPE encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import fields, fresh, map_batches, table

#: Added to the code point of a word's last symbol, so that "x at the end" is a symbol of its own.
END = 0x400
CACHED_PIECES = 400_000
CACHED_PAIRS = 500_000


def byte_symbols() -> dict[int, str]:
    """Printable symbol of each byte: itself where Latin-1 prints it, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file with word ends: merges as a tree, tokens as a suffix-link automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.number = {i: str(i) for i in self.name}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.specials = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))).finditer if self.special else None
        self.symbols = {b: c for b, c in byte_symbols().items()}
        self.merge, self.left, self.right, self.rank = {}, {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[a, b] = rank
            if made not in self.rank:
                self.left[made], self.right[made], self.rank[made] = a, b, rank
        self.known = Remembered(self._pair, CACHED_PAIRS)
        self.automaton = ahocorasick.Automaton()
        sound: dict[int, bool] = {}
        for token, i in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            if i in self.rank:
                a, b = self.left[i], self.right[i]
                sound[i] = sound[a] and sound[b] and self._apart(a, b, whole=True)
            else:
                sound[i] = True
            if sound[i]:
                flat = token.removesuffix(self.suffix)
                word = flat[:-1] + chr(ord(flat[-1]) + END) if flat != token else token
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.cache = Remembered(self.encode_piece, CACHED_PIECES)
        self.chunks = Remembered(self.encode_chunk, CACHED_PIECES)
        self.shown = Remembered(self.show_chunk, CACHED_PIECES)

    def _apart(self, a: int, b: int, whole: bool = False) -> bool:
        """Whether the encodings of two neighbours never merge across their border.

        Seen backwards in time, the two symbols at the border are undone one merge at a time,
        the later merge first. While a pair stands at the border, each side waits for its own
        next merge; the pair joins if its rank comes before both (the left side wins a tie).
        ``whole`` leaves out the last pair, the one that makes a token of the two.
        """
        rank, merge = self.rank, self.merge
        last = float("inf")
        next_a = next_b = last
        while True:
            joins = merge.get((a, b))
            if joins is not None and joins < next_a and joins <= next_b and not (whole and next_a == next_b == last):
                return False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a == made_b == -1:
                return True
            if made_a > made_b:
                a, next_a = self.right[a], made_a
            else:
                b, next_b = self.left[b], made_b

    def _pair(self, pair: int) -> bool:
        return self._apart(pair >> 20, pair & 0xFFFFF)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the last token of every prefix, then the pointers back from the end."""
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        word = word[:-1] + chr(ord(word[-1]) + END)
        known = self.known
        last, start, at = [0] * len(word), [0] * len(word), -1
        for end, (token, n) in self.automaton.iter(word):
            if end != at:
                before = end - n
                if before < 0 or known[last[before] << 20 | token]:
                    last[end], start[end], at = token, before, end
        out, end = [], len(word) - 1
        while end >= 0:
            out.append(last[end])
            end = start[end]
        out.reverse()
        return tuple(out)

    def parts(self, text: str) -> Iterator[str | int]:
        """The text between special tokens, and the ids of those, in order."""
        start = 0
        if self.specials is not None and any(t in text for t in self.special):
            for m in self.specials(text):
                yield text[start : m.start()]
                yield self.special[m.group()]
                start = m.end()
        yield text[start:] if start else text

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pieces(self.normal(chunk))
        if len(pieces) == 1:
            return self.cache[pieces[0]]
        return tuple([i for piece in pieces for i in self.cache[piece]])

    def show_chunk(self, chunk: str) -> tuple[int, str, str]:
        ids = self.encode_chunk(chunk)
        return len(ids), " ".join([self.number[i] for i in ids]), " ".join([self.name[i] for i in ids])

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case character by character; white space is left to the split."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text.

        No piece holds a space, so each stretch between spaces stands for itself; it is split,
        normalised and encoded once per worker and then remembered, within a bound.
        """
        out: list[int] = []
        for part in self.parts(text or ""):
            if isinstance(part, int):
                out.append(part)
            else:
                for ids in map(self.chunks.__getitem__, part.replace("\n", " ").split(" ")):
                    out += ids
        return out

    def decode(self, ids: list[int] | None) -> str:
        """Tokens joined by spaces, as for a vocabulary file that names no decoder; unknown ids are left out."""
        return " ".join(self.name[i] for i in ids or () if i in self.name)

    def show(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids written in decimal and joined by spaces, and the decoded text."""
        found: list[tuple[int, str, str]] = []
        for part in self.parts(text or ""):
            if isinstance(part, int):
                found.append((1, str(part), self.name[part]))
            else:
                found += map(self.shown.__getitem__, part.replace("\n", " ").split(" "))
        found = [x for x in found if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


class Remembered(dict):
    """A function's results; all are dropped when there are too many."""

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.work(key)
        return got


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; null and empty texts give an empty list.

    The column ``ids`` takes a longer name if it is taken. Rows are independent: repeated rows
    repeat their result, an empty table stays empty, and a very long text costs linear time.
    """
    name, at = fresh(docs.columns, ids), docs.columns.index(text)
    schema = fields(docs.schema, (name, T.ArrayType(T.IntegerType())))
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            found = pa.array([vocab.encode(t) for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    return map_batches(docs, work, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that each list of ids stands for; null gives the empty text."""
    name, at = fresh(rows.columns, text), rows.columns.index(ids)
    schema = fields(rows.schema, (name, T.StringType()))
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            found = pa.array([vocab.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    return map_batches(rows, work, schema)


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column(1):
                n, ids, plain = vocab.show(value.as_py())
                counts.append(n)
                first.append(hashlib.sha256(ids.encode()).hexdigest())
                second.append(hashlib.sha256(plain.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=schema.names)

    return map_batches(rows, work, schema)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: number of tokens, digest of the ids, digest of the decoded text."""
    return digests(table(spark, sf_dir, "documents"), public_path())
