"""Question preparation: normalisation, rewriting, routing, vagueness, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.functions.text import (
    _col, contains_any, matches_any, referenced_standards, standard_filter_number,
)


def normalize_terms(query, dictionary=P.TERM_DICTIONARY) -> Column:
    """Every dictionary spelling replaced by its standard term, in the given order."""
    return reduce(lambda q, pair: F.replace(q, F.lit(pair[0]), F.lit(pair[1])), dictionary, _col(query))


def query_category(query, categories=P.QUERY_CATEGORIES) -> Column:
    """The category whose words occur in the query; null when several match."""
    hits = F.filter(
        F.array(*[F.when(contains_any(query, words), F.lit(name)) for name, words in categories.items()]),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def query_filters(query, categories=P.QUERY_CATEGORIES) -> Column:
    """Map of metadata filters read off a question."""
    entries = F.array(
        F.struct(F.lit("standard_no").alias("key"), standard_filter_number(query).alias("value")),
        F.struct(F.lit("category").alias("key"), query_category(query, categories).alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def synonym_rewrites(query, synonyms=P.SYNONYMS, per_word: int = 2, total: int = 3) -> Column:
    """The question and its synonym variants, at most ``total`` in all."""
    query = _col(query)
    variants = F.array(
        *[
            F.when(query.contains(word), F.replace(query, F.lit(word), F.lit(other)))
            for word, others in synonyms
            for other in others[:per_word]
        ]
    )
    distinct = F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (v != query)))
    return F.slice(F.concat(F.array(query), distinct), 1, total)


def expand_queries(df: DataFrame, text: str = "query_text", **options) -> DataFrame:
    """One row per rewrite; ``variant`` 0 is the question itself."""
    return df.select("*", F.posexplode(synonym_rewrites(text, **options)).alias("variant", "rewrite"))


def is_comparison(query, pattern=P.COMPARISON_PATTERN) -> Column:
    return (F.length(_col(query)) >= 12) & _col(query).rlike(pattern)


def is_multi_aspect(query, aspects=P.MULTI_ASPECT_PATTERN, intents=P.QUESTION_INTENT_PATTERN) -> Column:
    return (F.length(_col(query)) >= 12) & _col(query).rlike(aspects) & _col(query).rlike(intents)


def needs_resolution(query) -> Column:
    """Pronouns or an elliptical opening point back to an earlier turn."""
    return _col(query).rlike(P.COREFERENCE_PATTERN) | _col(query).rlike(P.ELLIPSIS_PATTERN)


def is_clearly_specific(query) -> Column:
    return matches_any(query, P.CLEARLY_SPECIFIC_PATTERNS)


def vagueness(query, vague_words=P.VAGUE_WORDS, specific=P.SPECIFIC_PATTERNS) -> Column:
    """Rule score 0..1: short and vague wording raises it, specifics lower it."""
    query = _col(query)
    n = F.length(query)
    count = reduce(lambda a, b: a + b, [query.contains(w).cast("int") for w in vague_words])
    size = F.when(n < 5, 0.4).when(n < 10, 0.2).otherwise(0.0)
    vague = F.least(F.lit(0.3), count * 0.15)
    detail = F.when(matches_any(query, specific), -0.1).otherwise(0.2)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), size + vague + detail)), 6)


def vagueness_strategy(score) -> Column:
    score = _col(score)
    return (
        F.when(score > 0.7, "clarify_required").when(score > 0.5, "clarify_optional").when(score > 0.3, "suggest").otherwise("none")
    )


def route(
    query,
    standard=P.ROUTE_STANDARD,
    clause=P.ROUTE_CLAUSE,
    comparison=P.ROUTE_COMPARISON,
    involves=P.ROUTE_INVOLVES,
    standard_pair=P.ROUTE_STANDARD_PAIR,
    constraints=P.ROUTE_CONSTRAINTS,
) -> Column:
    """Struct of lane and the rule that decided it; the first rule that fires wins."""
    query = _col(query)
    decide = lambda lane, rule: F.struct(F.lit(lane).alias("lane"), F.lit(rule).alias("rule"))
    return (
        F.when(query.rlike(standard_pair), decide("slow", "standard_pair"))
        .when(F.regexp_count(query, F.lit(standard)) >= 2, decide("slow", "several_standards"))
        .when(query.rlike(comparison) | query.rlike(involves) | query.rlike(constraints), decide("slow", "multi_hop_words"))
        .when(query.rlike(standard) | query.rlike(clause), decide("fast", "explicit_number"))
        .otherwise(decide("fast", "default"))
    )


def content_keywords(query, strip=P.CONTENT_STANDARD_STRIP, stop_words=P.CONTENT_STOP_WORDS, limit: int = 5) -> Column:
    """Words of two or more characters left after standard numbers and filler words."""
    q = F.regexp_replace(_col(query), strip, "")
    q = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit(" ")), stop_words, q)
    return F.slice(F.filter(F.split(F.trim(q), r"\s+"), lambda w: F.length(w) >= 2), 1, limit)


def gap_needs(gaps) -> Column:
    """What the gaps ask for once lead-ins and standard numbers are removed."""
    cleaned = F.transform(
        _col(gaps),
        lambda g: F.trim(F.regexp_replace(F.regexp_replace(g, P.GAP_PREFIX_PATTERN, ""), P.GAP_STANDARD_PATTERN, "")),
    )
    kept = F.filter(cleaned, lambda g: g != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(P.GAP_DEFAULT_NEED)


def refine_for_gaps(query, gaps) -> Column:
    """Second-round question built from the gaps of the first answer."""
    query, gaps = _col(query), _col(gaps)
    named = F.array_distinct(F.flatten(F.transform(gaps, referenced_standards)))
    return (
        F.when(F.size(gaps) == 0, query)
        .when(F.size(named) > 0, F.concat_ws(" ", gap_needs(gaps), F.array_join(named, " ")))
        .otherwise(F.concat_ws(" ", query, F.array_join(gaps, "、")))
    )
