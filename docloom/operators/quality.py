"""Page and document quality: sampling, signals, text/scan classification, exact repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.functions import signals as G
from docloom.functions.text import content_hash
from docloom.operators.skew import best_row

Q = P.QUALITY


def sample_pages(page_count, maximum: int = Q["max_pages"]) -> Column:
    """Zero-based numbers of at most ``maximum`` evenly spaced pages (halves round to even)."""
    n = F.col(page_count) if isinstance(page_count, str) else page_count
    step = lambda i: F.bround(i * (n - 1) / F.lit(max(maximum - 1, 1)), 0).cast("long")
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(maximum - 1)), step))
    everything = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: i)
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= maximum, everything).otherwise(spread)


def page_range(pages: DataFrame, counts: DataFrame, start: int = 0, end: int | None = None, key: str = "doc_id") -> DataFrame:
    """Pages from ``start`` to ``end``; no end or -1 means the last page, too far is clamped."""
    last = F.col("page_count") - 1
    stop = last if end is None or end < 0 else F.least(F.lit(end), last)
    bounded = counts.select(key, stop.alias("_stop"))
    return pages.join(bounded, key).where((F.col("page_idx") >= start) & (F.col("page_idx") <= F.col("_stop"))).drop("_stop")


def page_signals(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row of counts per page; everything is computed inside the row."""
    clean = G.visible(text)
    base = pages.withColumn("_clean", clean)
    runs = G.punctuation_runs("_clean")
    return base.select(
        "doc_id", "page_idx",
        F.length(text).cast("long").alias("chars"), F.length("_clean").cast("long").alias("clean_chars"),
        G.abnormal_chars(text).alias("abnormal"), G.count(text, G.REPLACEMENT).alias("map_errors"),
        G.count("_clean", G.CJK).alias("cjk"), G.count("_clean", r"[\x{4E00}-\x{9FFF}]").alias("base_cjk"),
        G.rare_cjk("_clean").alias("rare_cjk"), G.script_counts("_clean").alias("scripts"),
        G.count("_clean", G.PUNCTUATION).alias("punct"), runs["chars"].alias("run_chars"), runs["kinds"].alias("run_kinds"),
    )


def punctuation_trigger(min_chars=Q["punct_min_chars"], ratio=Q["punct_ratio"], run_ratio=Q["punct_run_ratio"]) -> Column:
    """Per page: dense punctuation in long runs of several marks."""
    n = F.col("clean_chars")
    return (
        (n >= min_chars) & (F.try_divide("punct", n) >= ratio) & (F.try_divide("run_chars", n) >= run_ratio) & (F.col("run_kinds") > 1)
    )


def document_signals(signals: DataFrame) -> DataFrame:
    """Page signals summed per document, combined on the map side."""
    n = len(P.SCRIPT_RANGES)
    sums = [F.sum(F.col("scripts")[i]).alias(f"_s{i}") for i in range(n)]
    agg = signals.withColumn("_p", F.coalesce(punctuation_trigger(), F.lit(False))).groupBy("doc_id").agg(
        F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("chars", "clean_chars", "abnormal", "map_errors", "cjk", "base_cjk", "rare_cjk")],
        F.bool_or("_p").alias("punct_trigger"), *sums,
    )
    scripts = F.array(*[F.col(f"_s{i}") for i in range(n)])
    return agg.withColumn("foreign", F.aggregate(scripts, F.lit(0).cast("long"), lambda a, x: a + x)).withColumn(
        "dense_scripts", F.size(F.filter(scripts, lambda x: x >= Q["script_dense_chars"]))
    ).drop(*[f"_s{i}" for i in range(n)])


def classification_reason(limits: dict | None = None) -> Column:
    """The first rule that calls a document unreadable as text; empty when none does."""
    q = {**Q, **(limits or {})}
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        F.when(F.col("pages") == 0, "no_pages")
        .when(ratio("clean_chars", "pages") < q["min_chars_per_page"], "few_chars")
        .when(ratio("map_errors", "chars") >= q["map_error_ratio"], "map_errors")
        .when((F.col("chars") >= q["quality_min_chars"]) & (ratio("abnormal", "chars") >= q["quality_bad_ratio"]), "abnormal_chars")
        .when(
            (F.col("clean_chars") >= q["script_min_chars"]) & (F.col("cjk") >= q["script_min_cjk"]) & (F.col("foreign") >= q["script_count"])
            & (ratio("foreign", "clean_chars") >= q["script_ratio"]) & (F.col("dense_scripts") >= q["script_kinds"]), "cross_script",
        )
        .when((F.col("rare_cjk") >= q["rare_cjk_count"]) & (ratio("rare_cjk", "base_cjk") >= q["rare_cjk_ratio"]), "rare_cjk")
        .when(F.col("punct_trigger"), "punctuation")
        .otherwise("")
    )


def classify_documents(pages: DataFrame, limits: dict | None = None) -> DataFrame:
    """Text or scan per document, from its sampled pages: rows (doc_id, label, reason)."""
    counts = pages.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("_n"))
    sampled = pages.join(counts, "doc_id").where(F.array_contains(sample_pages("_n"), F.col("page_idx"))).drop("_n")
    judged = document_signals(page_signals(sampled)).withColumn("reason", classification_reason(limits))
    return judged.select("doc_id", F.when(F.col("reason") == "", "txt").otherwise("ocr").alias("label"), "reason")


def text_layer(pages: DataFrame, share: float = 0.5, chars: int = 50, early_chars: int = 100) -> DataFrame:
    """Share of pages with text, and whether an early page has plenty."""
    n = F.length(F.trim("text"))
    return pages.groupBy("doc_id").agg(
        F.round(F.avg((n > chars).cast("double")), 6).alias("rate"), F.bool_or((F.col("page_idx") < 3) & (n > early_chars)).alias("early_text")
    ).withColumn("has_text_layer", F.col("rate") >= share)


def confident_text(score, minimum: float = 0.5, text=None, width=None, height=None, junk: Sequence[str] = (), junk_score: float = 0.8) -> Column:
    """Recognised text worth keeping: sure enough, and no tall junk token of middling score."""
    keep = score >= minimum
    if text is not None:
        keep = keep & ~(text.isin(list(junk)) & (score < junk_score) & (width < height))
    return keep


def distinct_in_document(chunks: DataFrame, text: str = "content", key: str = "doc_id", order: Sequence[str] = ("position",)) -> DataFrame:
    """First chunk of each content inside a document, parents before children."""
    parent_first = [F.when(F.col("chunk_type") == "parent", 0).otherwise(1)] if "chunk_type" in chunks.columns else []
    hashed = chunks.withColumn("_h", content_hash(text))
    return best_row(hashed, [key, "_h"], [*parent_first, *[F.asc(c) for c in order]]).drop("_h")
