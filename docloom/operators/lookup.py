"""Substring joins and the exact lookups of the multi-step lane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import bind
from docloom.operators.skew import best_row, salted_join, top_k
from docloom.session import cut_lineage

MAX_INLINE_WORDS = 2000
#: Longer lists of words are looked up by whole words of at most so many lengths, else by their first characters.
MAX_LENGTHS = 12
GRAM = 12
#: Hashes of words that are shipped to the tasks, so that only parts of a text that can be a word leave them.
MOST_SHIPPED = 500_000


def contains_join(texts: DataFrame, text: str, words: DataFrame, word: str, max_inline: int = MAX_INLINE_WORDS) -> DataFrame:
    """Rows of ``texts`` paired with every row of ``words`` whose word occurs in the text.

    A checked small word list is tested inside each text row. A longer one goes through an
    equi-join on hashed parts of the text, verified afterwards; both are exact.
    """
    distinct = words.select(F.col(word).alias("_word")).where(F.length("_word") > 0).distinct()
    if distinct.limit(max_inline + 1).count() <= max_inline:
        listed = distinct.agg(F.collect_list("_word").alias("a")).scalar()
        found = texts.withColumn("_all", listed).withColumn("_word", F.explode(F.filter("_all", lambda w: F.col(text).contains(w)))).drop("_all")
    else:
        # Words stand under all their characters where they have few lengths, else under the first ones.
        sizes = distinct.select(F.length("_word").alias("n")).distinct()
        most = GRAM if sizes.limit(MAX_LENGTHS + 1).count() > MAX_LENGTHS else None
        cut_at = F.length("_word") if most is None else F.least(F.length("_word"), F.lit(most))
        keyed = distinct.withColumn("_gram", F.xxhash64(F.substring("_word", F.lit(1), cut_at)))
        lengths = distinct.agg(F.collect_set(cut_at).alias("a")).scalar()
        grams = F.flatten(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.length(text)),
                lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(F.substring(F.col(text), i, n))),
            )
        )
        cut = texts.withColumn("_lengths", lengths).withColumn("_gram", F.explode(F.array_distinct(grams))).drop("_lengths")
        known = keyed.select("_gram").distinct()
        if known.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED:
            cut = cut.join(F.broadcast(known), "_gram", "left_semi")
        found = salted_join(cut, keyed, ["_gram"]).where(F.col(text).contains(F.col("_word"))).drop("_gram")
    return found.join(words, found["_word"] == words[word]).drop("_word")


def passage_matches(documents: DataFrame, passages: DataFrame, key: str, passage_key: str, text: str = "text", run: int = 5) -> DataFrame:
    """Rows (passage_key, key) of documents containing a passage verbatim.

    A passage of at least three words is looked up by a run of its inner words, which must
    be whole words of any text that contains it; the hit is verified on the characters.
    Shorter passages go through ``contains_join``.
    """
    blank = r"[ \t\n\r\f]+"
    split = passages.select(passage_key, F.col(text).alias("_passage"), F.split(F.trim(text), blank).alias("_w"))
    long = split.where(F.size("_w") >= 3).select(
        passage_key, "_passage", F.least(F.size("_w") - 2, F.lit(run)).alias("_len"),
        F.concat_ws(" ", F.slice("_w", F.lit(2), F.least(F.size("_w") - 2, F.lit(run)))).alias("_run"),
    )
    lengths = long.agg(F.collect_set("_len").alias("a")).scalar()

    def runs(words: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.size(words)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.size(words) - n + 1),
                    lambda i: F.struct(n.alias("_len"), F.concat_ws(" ", F.slice(words, i, n)).alias("_run")),
                ),
            )
        )

    cut = documents.select(key, text, lengths.alias("_lengths"))
    cut = cut.select(key, F.explode(bind(F.split(text, blank), runs)).alias("_r"))
    candidates = cut.select(key, "_r._len", "_r._run").join(long, ["_len", "_run"]).select(key, passage_key, "_passage").distinct()
    hits = candidates.join(documents.select(key, text), key).where(F.col(text).contains(F.col("_passage"))).select(passage_key, key)
    short = split.where(F.size("_w") < 3).select(passage_key, F.col("_passage").alias("_short"))
    few = contains_join(documents.select(key, text), text, short, "_short").select(passage_key, key)
    return hits.unionByName(few)


def fetch_clause(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """First chunk of an exact (standard_no, clause) per question, looked up once per clause."""
    on = ["standard_no", "clause"]
    first = best_row(chunks.join(asked.select(*on).distinct(), on, "left_semi"), on, [F.asc_nulls_first("position"), F.asc("chunk_id")])
    hits = salted_join(asked, first, on, spread_by=["query_id"])
    hits = hits.select(*on, *[c for c in [*chunks.columns, *asked.columns] if c not in on])
    return best_row(hits, ["query_id"], [F.asc_nulls_first("position"), F.asc("chunk_id")])


def related_documents(asked: DataFrame, documents: DataFrame, fields: Sequence[str], key: str = "doc_id", limit: int = 10) -> DataFrame:
    """Completed documents whose fields contain the question's keyword, at most ``limit``.

    ``asked`` has query_id, keyword and optionally category (null for any). Documents are
    ranked once per different keyword and category, whatever the number of questions.
    """
    done = documents.where(F.col("process_status") == "completed")
    joined = done.withColumn("_text", F.concat_ws("\u0001", *fields))
    hits = contains_join(joined, "_text", asked.select("keyword").distinct(), "keyword").drop("_text")
    free, bound = asked.where("category IS NULL").drop("category"), asked.where("category IS NOT NULL")
    answers = []
    for some, on in ((free, ["keyword"]), (bound, ["keyword", "category"])):
        best = top_k(hits.join(some.select(*on).distinct(), on, "left_semi"), on, [F.asc(key)], limit)
        answers.append(salted_join(some, best, on, spread_by=["query_id"]).select(*documents.columns, *[c for c in asked.columns if c != "category"], "rank"))
    return answers[0].unionByName(answers[1])


def table_keywords(title: Column) -> Column:
    """CJK runs and table numbers of two or more characters."""
    cjk = F.regexp_extract_all(title, F.lit("[一-鿿]+"), F.lit(0))
    numbers = F.regexp_extract_all(title, F.lit(r"\b[A-Z][0-9A-Z.]+\b"), F.lit(0))
    return F.array_distinct(F.filter(F.concat(cjk, numbers), lambda w: F.length(w) >= 2))


def find_tables(asked: DataFrame, tables: DataFrame, keywords: Column | None = None, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Tables whose title or number holds a keyword of the wanted title, and the questions
    left without any, which go back to text recall. A wanted title without keywords is
    answered by any table. Where ``asked`` has a standard_id, only tables whose standard_no
    holds it count."""
    within = "standard_id" in asked.columns
    limited = [F.col("standard_id").alias("_standard")] if within else []
    wanted = asked.select("query_id", (table_keywords(F.col("table_title")) if keywords is None else keywords).alias("_k"), *limited)
    # A question's first tables are among the first of each of its keywords, found once per keyword.
    words = wanted.select("query_id", F.explode("_k").alias("_keyword"), *[c.name for c in wanted.schema if c.name == "_standard"])
    # Titles and numbers repeat, so each different text is searched once.
    searched = tables.withColumn("_text", F.concat_ws("\u0001", "title", "table_number"))
    held = contains_join(searched.select("_text").distinct(), "_text", words.select("_keyword").distinct(), "_keyword")
    held = salted_join(searched, held, ["_text"], spread_by=["table_id"]).drop("_text")

    def first_of(some: DataFrame, holding: DataFrame, on: list[str]) -> DataFrame:
        best = top_k(holding.dropDuplicates([*on, "table_id"]), on, [F.asc("table_id")], limit, "_r")
        return salted_join(some.select("query_id", *on).distinct(), best.select(*on, *tables.columns), on, spread_by=["query_id"]).select("query_id", *tables.columns)

    open_ended = wanted.where(F.size("_k") == 0)
    if within:  # a title without keywords but with a standard: the first tables of that standard
        bound, named = words.where("_standard IS NOT NULL"), open_ended.where("_standard IS NOT NULL")
        standards = bound.select("_standard").unionByName(named.select("_standard")).distinct()
        numbers = contains_join(tables.select("standard_no").distinct(), "standard_no", standards, "_standard")
        pairs = bound.select("_keyword", "_standard").distinct()
        of_both = salted_join(held, numbers, ["standard_no"], spread_by=["table_id"]).join(pairs, ["_keyword", "_standard"], "left_semi")
        of_one = salted_join(tables, numbers, ["standard_no"], spread_by=["table_id"]).join(named.select("_standard").distinct(), "_standard", "left_semi")
        hits = first_of(words.where("_standard IS NULL"), held, ["_keyword"]).unionByName(first_of(bound, of_both, ["_keyword", "_standard"]))
        hits = hits.unionByName(first_of(named, of_one, ["_standard"]))
        open_ended = open_ended.where("_standard IS NULL")
    else:
        hits = first_of(words, held, ["_keyword"])
    hits = hits.dropDuplicates(["query_id", "table_id"])
    open_ended = open_ended.select("query_id")
    any_table = tables.orderBy("table_id").limit(limit).agg(F.collect_list(F.struct(*tables.columns)).alias("a")).scalar()
    free = open_ended.select("query_id", F.inline(any_table))
    # At most ``limit`` rows a question, read again to see which questions have none.
    found = cut_lineage(top_k(hits.select("query_id", *tables.columns).unionByName(free), ["query_id"], [F.asc("table_id")], limit))
    missing = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found, missing
