"""Conversation, cache, evaluation and feedback analytics over query logs.

Marked "design" are the operators whose formulas are specified for the log tables but
which run as periodic jobs outside the service.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import canonical_json, memo_key
from docloom.operators.nearest import similar_pairs
from docloom.operators.ordered import position_bucket, scan
from docloom.operators.recall import page_of
from docloom.operators.skew import best_row, salted_join, top_k

#: Latency percentiles of the KPI report.
PERCENTILES = (50, 95, 99)


# ---------------------------------------------------------------- conversations
def conversation_list(messages: DataFrame, by: Sequence[str], text: str, order: Sequence[str], title_chars: int = 50) -> DataFrame:
    """Count, first and last time, and the first message as title, in one aggregation."""
    first = F.min_by(text, F.struct(*order))
    title = F.when(F.length(first) > title_chars, F.concat(F.substring(first, 1, title_chars), F.lit("..."))).otherwise(
        F.coalesce(F.nullif(first, F.lit("")), F.lit("未命名会话"))
    )
    return messages.groupBy(*by).agg(
        F.count("*").alias("message_count"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), title.alias("title")
    )


def conversation_page(conversations: DataFrame, page: int = 1, size: int = 20, by: Sequence[str] = ("conv_id",)) -> DataFrame:
    """One page of conversations, last active first, with total and has_more."""
    return page_of(conversations, [F.desc("last_at"), *[F.asc(c) for c in by]], page, size)


def latest_turns(messages: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    """Latest ``n`` turns per conversation, numbered from the oldest of them."""
    kept = top_k(messages, [key], [F.desc(order)], n, "_back")
    counts = kept.groupBy(key).agg(F.count("*").alias("_n"))
    return kept.join(counts, key).withColumn("turn_no", F.col("_n") - F.col("_back") + 1).drop("_back", "_n")


def history_within_budget(turns: DataFrame, key: str, order: str, question: str, answer: str, budget: int = 2000, answer_chars: int = 500, bucket: int = 1024) -> DataFrame:
    """Latest turns whose characters/1.5 fit the budget; the oldest go first.

    Sizes are summed from the newest turn backwards with a bucketed scan, so a
    conversation of any length is spread over tasks.
    """
    cut = turns.withColumn(answer, F.substring(F.coalesce(answer, F.lit("")), 1, answer_chars)).withColumn(
        "_len", F.length(F.coalesce(question, F.lit(""))) + F.length(answer)
    )
    summed = scan(cut, [key], [order], position_bucket(order, bucket), sums={"chars_from_end": F.col("_len")}, descending=True)
    return summed.where(F.floor(F.col("chars_from_end") / 1.5) <= budget).drop("_len")


def context_summary(chunks: DataFrame, groups: int = 5, clauses: int = 3, snippets: int = 2, chars: int = 150) -> DataFrame:
    """What a question has gathered so far: per standard counts, clauses, tables, snippets.

    Chunks carry query_id, standard_no, clause, content_type, content and place (order of
    arrival). Every group is cut to what the summary shows before it is collected.
    """
    rows = chunks.withColumn("_std", F.coalesce(F.nullif("standard_no", F.lit("")), F.lit("未知标准")))
    stats = rows.groupBy("query_id", "_std").agg(
        F.count("*").alias("n"), F.count_if(F.col("content_type") == "table").alias("tables"), F.min("place").alias("_first")
    )
    shown = top_k(stats, ["query_id"], [F.asc("_first")], groups, "group_no")
    named = top_k(rows.where(F.coalesce("clause", F.lit("")) != ""), ["query_id", "_std"], [F.asc("place")], clauses, "_r")
    joined = lambda order, col, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda s: s[col]), sep)
    names = named.groupBy("query_id", "_std").agg(joined("place", "clause", ", ").alias("clauses"))
    mark = F.when(F.col("content_type") != "text", F.concat(F.lit("["), F.col("content_type"), F.lit("] "))).otherwise("")
    snippet = F.concat(F.lit("  └ "), mark, F.replace(F.substring("content", 1, chars), F.lit("\n"), F.lit(" ")), F.lit("…"))
    best = top_k(rows.withColumn("_snip", snippet), ["query_id", "_std"], [F.asc("place")], snippets, "_r")
    snips = best.groupBy("query_id", "_std").agg(joined("place", "_snip", "\n").alias("_snips"))
    full = shown.join(names, ["query_id", "_std"], "left").join(snips, ["query_id", "_std"], "left")
    head = F.concat(
        F.lit("- "), F.col("_std"), F.lit(": "), F.col("n").cast("string"), F.lit(" 条相关内容"),
        F.coalesce(F.concat(F.lit("（条款："), F.col("clauses"), F.lit("）")), F.lit("")),
        F.when(F.col("tables") > 0, F.concat(F.lit("（含"), F.col("tables").cast("string"), F.lit("个表格）"))).otherwise(""),
    )
    drawn = full.withColumn("_block", F.concat_ws("\n", head, "_snips"))
    return drawn.groupBy("query_id").agg(joined("group_no", "_block", "\n").alias("summary"))


# ---------------------------------------------------------------- caches
def filters_hash(filters) -> Column:
    """Digest of a filter map, equal for equal maps whatever their order."""
    return F.md5(canonical_json(filters))


def recall_key(query, filters, hyde: Column, expanded) -> Column:
    return memo_key("recall", query, canonical_json(filters), hyde.cast("string"), F.array_join(F.sort_array(expanded), ","))


def rerank_key(query, stage, k, model, chunk_ids) -> Column:
    return memo_key("rerank", query, stage, k.cast("string"), model, F.array_join(F.transform(F.sort_array(chunk_ids), lambda c: c.cast("string")), ","))


def generation_key(query, contents) -> Column:
    return memo_key("generation", query, F.array_join(contents, ""))


def memo_join(requests: DataFrame, memo: DataFrame, key: str = "memo_key") -> tuple[DataFrame, DataFrame]:
    """Requests answered from the memo, and the distinct keys still to compute."""
    hits = salted_join(requests, memo, [key])
    misses = requests.join(memo.select(key), key, "left_anti").dropDuplicates([key])
    return hits, misses


def semantic_lookup(lookups: DataFrame, entries: DataFrame, threshold: float = 0.95, ttl_seconds: int = 21600) -> DataFrame:
    """Most similar fresh entry with the same filters per lookup.

    Both sides carry filters_hash and vector; lookups have lookup_id and asked_at, entries
    entry_id and created_at. Expired entries are out before the best is chosen.

    Time is cut into spans as long as an entry lives, so a lookup meets the entries of its own
    span and of the one before, never the rest of the cache.
    """
    span = lambda at: F.floor(F.unix_timestamp(at) / max(int(ttl_seconds), 1))
    asked = lookups.withColumn("_span", span("asked_at")).where(F.col("_span").isNotNull())
    held = entries.withColumn("_span", F.explode(F.array(span("created_at"), span("created_at") + 1))).where(F.col("_span").isNotNull())
    pairs = similar_pairs(asked, held, ["filters_hash", "_span"], "lookup_id", "entry_id", threshold).drop("_span")
    timed = pairs.join(lookups.select("lookup_id", "asked_at"), "lookup_id").join(entries.select("entry_id", "created_at"), "entry_id")
    age = F.unix_timestamp("asked_at") - F.unix_timestamp("created_at")
    fresh = timed.where((age >= 0) & (age <= ttl_seconds))
    return best_row(fresh, ["lookup_id"], [F.desc("similarity"), F.asc("entry_id")]).select("lookup_id", "entry_id", "similarity")


def hit_rates(events: DataFrame, level: str, hit: Column) -> DataFrame:
    counted = events.groupBy(level).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return counted.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)), 6))


# ---------------------------------------------------------------- evaluation (design: A29, A30)
def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: Sequence[int] = (3, 5)) -> DataFrame:
    """Recall@k and MRR over questions that have expected chunks."""
    expected = truth.select("query_id", "chunk_id").distinct()
    sizes = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    found = expected.join(ranked.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in ks]
    )
    rows = sizes.join(found, "query_id", "left")
    return rows.agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(F.coalesce(f"hit{k}", F.lit(0)) / F.col("n")), 6).alias(f"recall_at_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def regression_alert(current: Column, previous: Column, drop: float = 0.02) -> Column:
    return current < previous - drop


def experiment_decision(rows: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Rollout, rollback or manual per experiment from its two variants.

    Rows carry variant (control, treatment), hit (0/1 recall@5), satisfied and latency.
    """
    # Equal measurements are counted first, so the exact percentile holds distinct values only.
    counted = rows.groupBy(*keys, "variant", "latency").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"_{c}") for c in ("hit", "satisfied")], *[F.count(c).alias(f"_n_{c}") for c in ("hit", "satisfied")])
    stats = counted.groupBy(*keys, "variant").agg(
        (F.sum("_hit") / F.sum("_n_hit")).alias("recall"), (F.sum("_satisfied") / F.sum("_n_satisfied")).alias("satisfaction"), F.percentile("latency", 0.95, F.col("n")).alias("p95")
    )
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    lift = stats.groupBy(*keys).agg(
        *[(of("treatment", c) - of("control", c)).alias(n) for c, n in (("recall", "recall_lift"), ("satisfaction", "satisfaction_lift"), ("p95", "latency_diff"))]
    )
    decision = (
        F.when((F.col("recall_lift") > 0.03) & (F.col("satisfaction_lift") > 0.05) & (F.col("latency_diff") < 200), "rollout")
        .when((F.col("recall_lift") < -0.02) | (F.col("latency_diff") > 500), "rollback").otherwise("manual")
    )
    return lift.select(*keys, *[F.round(c, 6).alias(c) for c in ("recall_lift", "satisfaction_lift", "latency_diff")], decision.alias("decision"))


# ---------------------------------------------------------------- feedback loops (design: A31-A35)
def clarification_rates(logs: DataFrame) -> DataFrame:
    """Error kinds of the clarification step over logs with clarified, skipped, success, retried, choice."""
    wrong = F.col("clarified") & F.col("skipped") & F.col("success")
    missed = ~wrong & ~F.col("clarified") & F.col("retried")
    options = ~wrong & ~missed & F.col("clarified") & (F.col("choice") == "other")
    n = F.count("*")
    return logs.agg(
        n.alias("logs"), F.count_if(wrong).alias("false_positive"), F.count_if(missed).alias("false_negative"), F.count_if(options).alias("bad_options"),
        F.round(F.count_if(wrong) / n, 6).alias("false_positive_rate"), F.round(F.count_if(missed) / n, 6).alias("false_negative_rate"),
    )


def example_tier(quality: Column, frequency: Column) -> Column:
    """What happens to a wrongly clarified question: auto, review or reject."""
    return (
        F.when((quality > 0.7) & (frequency >= 3), "auto").when(quality.between(0.5, 0.7) | (frequency == 2), "review")
        .when((quality < 0.5) | (frequency < 2), "reject").otherwise("none")
    )


def mine_terms(inputs: DataFrame, dictionary: DataFrame, pattern: str) -> DataFrame:
    """Custom inputs grouped by (user_input, original_query), rated and sorted into tiers.

    A term is similar to the dictionary when they share their first two characters and
    differ by at most two edits; the shared start is the join key.
    """
    grouped = inputs.groupBy("user_input", "original_query").agg(F.count("*").alias("frequency"), F.avg(F.col("success").cast("double")).alias("_ok"))
    start = lambda c: F.lower(F.substring(c, 1, 2))
    known = dictionary.select(F.col("term").alias("_term"), start("term").alias("_start")).distinct()
    asked = grouped.select("user_input").distinct().withColumn("_start", start("user_input"))
    similar = salted_join(asked, known, ["_start"]).where(F.levenshtein("user_input", "_term") <= 2).select("user_input").distinct().withColumn("_sim", F.lit(True))
    rated = grouped.join(similar, "user_input", "left")
    confidence = (
        F.when(F.col("frequency") >= 5, 0.4).when(F.col("frequency") >= 3, 0.2).otherwise(0.0) + F.col("_ok") * 0.3
        + F.when(F.col("_sim"), 0.2).otherwise(0.0) + F.when(F.col("user_input").rlike(pattern), 0.1).otherwise(0.0)
    )
    rated = rated.withColumn("confidence", F.round(F.least(confidence, F.lit(1.0)), 6))
    tier = (
        F.when((F.col("frequency") >= 5) & (F.col("confidence") > 0.8), "auto_add")
        .when((F.col("frequency") <= 2) | (F.col("confidence") < 0.3), "reject").otherwise("review")
    )
    return rated.select("user_input", "original_query", "frequency", "confidence", tier.alias("tier"))


def term_coverage(queries: DataFrame, dictionary: DataFrame, text: str = "query_text") -> DataFrame:
    """Share of questions in which a dictionary term occurs."""
    from docloom.operators.lookup import contains_join

    hit = contains_join(queries.select("query_id", text), text, dictionary.select("term").distinct(), "term").select("query_id").distinct()
    marked = queries.select("query_id").join(hit.withColumn("_h", F.lit(1.0)), "query_id", "left")
    return marked.agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce("_h", F.lit(0.0))), 6).alias("coverage"))


def bad_case_causes(cases: DataFrame, known_documents: DataFrame, parents: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Why a question failed: missing_doc, embedding or reranking.

    cases (case_id, expected_doc), parents (expected_doc, chunk_id), retrieved (case_id, chunk_id).
    """
    known = known_documents.select(F.col("doc_id").alias("expected_doc")).distinct().withColumn("_known", F.lit(True))
    reached = retrieved.join(cases.select("case_id", "expected_doc"), "case_id")
    reached = salted_join(reached, parents.select("expected_doc", "chunk_id"), ["expected_doc", "chunk_id"], "left_semi", spread_by=["case_id"])
    reached = reached.select("case_id").distinct().withColumn("_hit", F.lit(True))
    joined = salted_join(cases, known, ["expected_doc"], "left", spread_by=["case_id"]).join(reached, "case_id", "left")
    cause = F.when(F.col("_known").isNull(), "missing_doc").when(F.col("_hit").isNull(), "embedding").otherwise("reranking")
    return joined.withColumn("root_cause", cause).drop("_known", "_hit")


def query_kpis(logs: DataFrame, *by: str) -> DataFrame:
    """Lane mix, retries, clarification and latency, with subtotals over ``by``.

    Latency percentiles are exact: the least value that has at least that share of the rows at
    or below it. Equal latencies are counted first and summed up by a bucketed scan.
    """
    grouped = logs.rollup(*by) if by else logs.groupBy()
    stats = grouped.agg(
        (F.grouping_id() if by else F.lit(0)).cast("long").alias("_level"), F.count("total_time").alias("_timed"),
        F.count("*").alias("queries"), F.round(F.avg((F.col("lane") == "slow").cast("double")), 6).alias("slow_share"),
        F.round(F.avg((F.col("retry_count") > 0).cast("double")), 6).alias("retry_rate"),
        F.round(F.avg(F.col("clarified").cast("double")), 6).alias("clarification_rate"),
    )
    key = ["_level", *by]
    counted, levels = logs.where("total_time IS NOT NULL").groupBy(*by, "total_time").agg(F.count("*").alias("_c")), []
    for kept in range(len(by), -1, -1):
        level = counted.groupBy(*by[:kept], "total_time").agg(F.sum("_c").alias("_c"))
        dropped = [F.lit(None).cast(logs.schema[b].dataType).alias(b) for b in by[kept:]]
        levels.append(level.select(F.lit((1 << len(by) - kept) - 1).cast("long").alias("_level"), *by[:kept], *dropped, "total_time", "_c"))
    placed = scan(reduce(DataFrame.unionByName, levels), key, ["total_time"], position_bucket("total_time"), sums={"_upto": F.col("_c")})
    same = lambda l, r: reduce(lambda x, y: x & y, [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in key])
    sized = placed.alias("v").join(stats.select(*key, "_timed").alias("s"), same("v", "s")).select("v.*", "_timed")
    ranks = sized.groupBy(*key).agg(*[F.min(F.when(F.col("_upto") * 100 >= F.col("_timed") * p, F.col("total_time"))).alias(f"p{p}") for p in PERCENTILES])
    return stats.alias("s").join(ranks.alias("v"), same("s", "v"), "left").select(
        *[F.col(f"s.{b}").alias(b) for b in by], "queries", "slow_share", "retry_rate", "clarification_rate", *[f"p{p}" for p in PERCENTILES],
        (F.col("clarification_rate") > 0.25).alias("clarification_alert"),
    )


def sample_logs(logs: DataFrame, key: str, abnormal: Column, percent: int = 10, hashed: Column | None = None) -> DataFrame:
    """All abnormal rows and a repeatable share of the others."""
    h = F.xxhash64(key) if hashed is None else hashed
    return logs.where(abnormal | (F.pmod(h, F.lit(100)) < percent))


def latest_feedback(feedback: DataFrame, key: str, order: Sequence[str], score: str, by: Sequence[str]) -> DataFrame:
    """Mean of the latest score per query, grouped."""
    last = feedback.groupBy(key, *by).agg(F.max_by(score, F.struct(*order)).alias("score"))
    return last.groupBy(*by).agg(F.count("*").alias("rated"), F.round(F.avg("score"), 6).alias("mean_score"))
