"""Character-level quality signals of a text, as counts a page can be judged by."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.functions.text import _col

REPLACEMENT = r"\x{FFFD}"
NULL = r"\x{0000}"
CONTROL = r"[\x{0001}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def char_class(ranges: Iterable[tuple[int, int]]) -> str:
    """Regular-expression class of code point ranges."""
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


CJK = char_class(P.CJK_RANGES)


def count(text, pattern: str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern)).cast("long")


def visible(text) -> Column:
    """Text without any whitespace."""
    return F.regexp_replace(_col(text), r"[\s\x{00A0}\x{3000}]", "")


def abnormal_chars(text) -> Column:
    return count(text, NULL) + count(text, REPLACEMENT) + count(text, CONTROL) + count(text, PRIVATE_USE)


def rare_cjk(text) -> Column:
    a, b = P.RARE_CJK_RANGE
    every = count(text, char_class([(a, b)]))
    return every - count(text, f"[{P.RARE_CJK_WHITELIST}]")


def punctuation_runs(text, minimum: int = P.QUALITY["punct_run"]) -> Column:
    """Struct of the characters inside long punctuation runs and of the distinct marks in them."""
    runs = F.regexp_extract_all(_col(text), F.lit(PUNCTUATION + "{%d,}" % minimum), F.lit(0))
    joined = F.array_join(runs, "")
    kinds = F.size(F.array_remove(F.array_distinct(F.split(joined, "")), ""))
    return F.struct(F.length(joined).cast("long").alias("chars"), kinds.alias("kinds"))


def script_counts(text) -> Column:
    """Array of the character count of each foreign script, in the order of the ranges."""
    return F.array(*[count(text, char_class([(a, b)])) for a, b, _ in P.SCRIPT_RANGES])


def private_use(text) -> Column:
    """Struct of private-use count, visible characters, ratio and longest run."""
    text = _col(text)
    runs = F.transform(F.regexp_extract_all(text, F.lit(PRIVATE_USE + "+"), F.lit(0)), lambda r: F.length(r))
    n, total = count(text, PRIVATE_USE), F.length(visible(text)).cast("long")
    return F.struct(
        n.alias("count"), total.alias("chars"), F.round(F.coalesce(F.try_divide(n, total), F.lit(0.0)), 6).alias("ratio"),
        F.coalesce(F.array_max(runs), F.lit(0)).alias("longest_run"),
    )


def needs_ocr_for_private_use(signal: Column, min_count: int = 2, min_run: int = 2, min_ratio: float = 0.05) -> Column:
    return (signal["count"] >= min_count) & ((signal["longest_run"] >= min_run) | (signal["ratio"] >= min_ratio))
