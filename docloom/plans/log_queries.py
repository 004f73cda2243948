"""Registered queries of conversations, caches, evaluation and feedback analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import logs, search
from docloom.operators.lookup import passage_matches
from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.retrieval_queries import document_words
from docloom.plans.sql_tables import with_
from docloom.plans.text_queries import mod


@query("A7", """SELECT conv_id, count(*) AS message_count, min(turn) AS first_at, max(turn) AS last_at, CASE WHEN length(arg_min(text, turn)) > 50 THEN left(arg_min(text, turn), 50) || '...' ELSE arg_min(text, turn) END AS title FROM conversations GROUP BY 1""")
def conversation_list(c):
    """Every conversation with its size and title."""
    return logs.conversation_list(c.table("conversations"), ["conv_id"], "text", ["turn"])


@query("A7 K7", """SELECT conv_id, count(*) AS message_count, min(turn) AS first_at, max(turn) AS last_at, CASE WHEN length(arg_min(text, turn)) > 50 THEN left(arg_min(text, turn), 50) || '...' ELSE arg_min(text, turn) END AS title,
  (SELECT count(DISTINCT conv_id) FROM conversations) AS total, (SELECT count(DISTINCT conv_id) FROM conversations) > 20 AS has_more FROM conversations GROUP BY 1 ORDER BY last_at DESC, conv_id LIMIT 10 OFFSET 10""")
def conversation_page(c):
    """Second page of ten conversations, last active first."""
    return logs.conversation_page(conversation_list(c), 2, 10)


@query("W2", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 5""")
def latest_turns(c):
    """Five latest turns of every conversation, oldest first."""
    return logs.latest_turns(c.table("conversations").select("conv_id", "turn"), "conv_id", "turn").withColumn("turn_no", F.col("turn_no").cast("long"))


@query("W3", """WITH t AS (SELECT conv_id, turn, length(text) // 3 + least(500, length(text)) AS n FROM conversations),
s AS (SELECT conv_id, turn, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_from_end FROM t)
SELECT conv_id, turn, chars_from_end FROM s WHERE floor(chars_from_end / 1.5) <= 1000""")
def history_budget(c):
    """Turns that fit the history budget."""
    t = c.table("conversations").select("conv_id", "turn", F.repeat(F.lit("q"), F.floor(F.length("text") / 3).cast("int")).alias("question"), F.col("text").alias("answer"))
    return logs.history_within_budget(t, "conv_id", "turn", "question", "answer", budget=1000, bucket=4).select("conv_id", "turn", "chars_from_end")


@query("A26", """WITH r AS (SELECT conv_id AS query_id, turn AS place, CASE WHEN turn % 4 = 3 THEN '未知标准' ELSE 'GB ' || (turn % 4) END AS std, CASE WHEN turn % 2 = 0 THEN '5.' || turn ELSE '' END AS clause, CASE WHEN role = 'assistant' THEN 'table' ELSE 'text' END AS kind, text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, std ORDER BY place) AS i, sum((clause <> '')::INT) OVER (PARTITION BY query_id, std ORDER BY place) AS ci FROM r),
g AS (SELECT query_id, std, count(*) AS n, sum((kind = 'table')::INT) AS tables, min(place) AS f, string_agg(clause, ', ' ORDER BY place) FILTER (clause <> '' AND ci <= 3) AS cl,
  string_agg('  └ ' || CASE WHEN kind <> 'text' THEN '[' || kind || '] ' ELSE '' END || replace(left(text, 150), chr(10), ' ') || '…', chr(10) ORDER BY place) FILTER (i <= 2) AS sn FROM n GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS gi FROM g)
SELECT query_id, string_agg('- ' || std || ': ' || n || ' 条相关内容' || coalesce('（条款：' || cl || '）', '') || CASE WHEN tables > 0 THEN '（含' || tables || '个表格）' ELSE '' END || chr(10) || sn, chr(10) ORDER BY gi) AS summary FROM o WHERE gi <= 5 GROUP BY 1""")
def context_summary(c):
    """What each conversation has gathered, by standard."""
    rows = c.table("conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.when(mod("turn", 4) == 3, "").otherwise(F.concat(F.lit("GB "), mod("turn", 4).cast("string"))).alias("standard_no"),
        F.when(mod("turn", 2) == 0, F.concat(F.lit("5."), F.col("turn").cast("string"))).otherwise("").alias("clause"),
        F.when(F.col("role") == "assistant", "table").otherwise("text").alias("content_type"), F.col("text").alias("content"),
    )
    return logs.context_summary(rows)


@query("J27", """WITH l AS (SELECT vec_id AS lookup_id, label % 3 AS fh, embedding::DOUBLE[] AS v, vec_id * 60 AS ts0 FROM embeddings), e AS (SELECT lookup_id AS entry_id, fh, v, ts0 FROM l),
p AS (SELECT lookup_id, entry_id, round(list_dot_product(l.v, e.v) / sqrt(list_dot_product(l.v, l.v) * list_dot_product(e.v, e.v)), 6) AS similarity, l.ts0 - e.ts0 AS age FROM l JOIN e USING (fh) WHERE entry_id <> lookup_id)
SELECT lookup_id, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY similarity DESC, entry_id) AS r FROM p WHERE similarity >= 0.3 AND age BETWEEN 0 AND 7200) WHERE r = 1""".replace("WHERE entry_id <> lookup_id", ""))
def cache_lookup_ttl(c):
    """Most similar fresh cache entry with equal filters."""
    e = c.table("embeddings").select(
        F.col("vec_id").alias("lookup_id"), logs.filters_hash(F.create_map(F.lit("g"), mod("label", 3).cast("string"))).alias("filters_hash"),
        F.col("embedding").alias("vector"), F.timestamp_seconds(F.col("vec_id") * 60).alias("asked_at"),
    )
    entries = e.select(F.col("lookup_id").alias("entry_id"), "filters_hash", "vector", F.col("asked_at").alias("created_at"))
    return logs.semantic_lookup(e, entries, 0.3, 7200)


MEMO = """r AS (SELECT event_id, md5(concat_ws('|', event_type, CAST(user_id % 20 AS VARCHAR))) AS memo_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_trunc('day', ts) AS d FROM events), m AS (SELECT memo_key, max(k) AS answer FROM r WHERE d < TIMESTAMP '2024-01-02' GROUP BY 1)"""


def memo_tables(c):
    r = c.table("events").select(
        "event_id", F.md5(F.concat_ws("|", "event_type", mod("user_id", 20).cast("string"))).alias("memo_key"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts",
    )
    m = r.where(F.col("ts") < F.to_timestamp(F.lit("2024-01-02"))).groupBy("memo_key").agg(F.max("k").alias("answer"))
    return r.select("event_id", "memo_key"), m


@query("J28 C1", with_(MEMO) + "SELECT event_id, memo_key, answer FROM r JOIN m USING (memo_key)")
def memo_join(c):
    """Requests answered from the memo table."""
    return logs.memo_join(*memo_tables(c))[0].select("event_id", "memo_key", "answer")


@query("J28", with_(MEMO) + "SELECT DISTINCT memo_key FROM r WHERE memo_key NOT IN (SELECT memo_key FROM m)")
def memo_misses(c):
    """Distinct keys left to compute."""
    return logs.memo_join(*memo_tables(c))[1].select("memo_key")


@query("A23", "SELECT event_type, count(*) FILTER (value > 50) AS hits, count(*) FILTER (NOT value > 50) AS misses, round(count(*) FILTER (value > 50) / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def cache_hit_rates(c):
    """Hits, misses and rate per cache level."""
    return logs.hit_rates(c.table("events"), "event_type", F.col("value") > 50)


@query("A29", with_(S.BM25) + """, tr AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
n AS (SELECT query_id, count(*) AS n FROM tr GROUP BY 1), f AS (SELECT query_id, min(rank) AS first, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5 FROM tr JOIN rk USING (query_id, doc_id) WHERE rank <= 20 GROUP BY 1)
SELECT count(*) AS questions, round(avg(coalesce(h3, 0) / n), 6) AS recall_at_3, round(avg(coalesce(h5, 0) / n), 6) AS recall_at_5, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM n LEFT JOIN f USING (query_id)""")
def eval_recall_mrr(c):
    """Recall@3, Recall@5 and MRR of keyword search against the verbatim truth."""
    ranked = search.keyword_topk(c.queries(), document_words(c), "doc_id", 20).withColumnRenamed("doc_id", "chunk_id")
    truth = passage_matches(c.table("documents").select("doc_id", "text"), c.table("benchmark").select("item_id", "text"), "doc_id", "item_id")
    return logs.retrieval_metrics(ranked, truth.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id")))


@query("A30", with_(S.QUERY_LOGS) + """, v AS (SELECT event_type AS experiment, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, (value < 60)::INT AS hit, (feedback_score >= 4)::INT AS satisfied, total_time AS latency FROM query_logs),
s AS (SELECT experiment, variant, avg(hit) AS r, avg(satisfied) AS s, quantile_cont(latency, 0.95) AS p FROM v GROUP BY 1, 2),
l AS (SELECT t.experiment, t.r - c.r AS rl, t.s - c.s AS sl, t.p - c.p AS ld FROM s t JOIN s c ON c.experiment = t.experiment AND c.variant = 'control' WHERE t.variant = 'treatment')
SELECT experiment, round(rl, 6) AS recall_lift, round(sl, 6) AS satisfaction_lift, round(ld, 6) AS latency_diff, CASE WHEN rl > 0.03 AND sl > 0.05 AND ld < 200 THEN 'rollout' WHEN rl < -0.02 OR ld > 500 THEN 'rollback' ELSE 'manual' END AS decision FROM l""")
def ab_decision(c):
    """Decision per running experiment."""
    rows = c.query_logs().select(
        F.col("event_type").alias("experiment"), F.when(mod("user_id", 2) == 0, "control").otherwise("treatment").alias("variant"),
        (F.col("value") < 60).cast("int").alias("hit"), (F.col("feedback_score") >= 4).cast("int").alias("satisfied"), F.col("total_time").alias("latency"),
    )
    return logs.experiment_decision(rows)


@query("A34", with_(S.QUERY_LOGS) + """, g AS (SELECT coalesce(event_type, '*') AS event_type, coalesce(lane, '*') AS lane, count(*) AS queries, round(avg((lane = 'slow')::INT), 6) AS x, round(avg((retry_count > 0)::INT), 6) AS retry_rate, round(avg(clarified::INT), 6) AS clarification_rate,
  quantile_disc(total_time, 0.5) AS p50, quantile_disc(total_time, 0.95) AS p95, quantile_disc(total_time, 0.99) AS p99 FROM (SELECT * FROM query_logs) GROUP BY ROLLUP (event_type, lane))
SELECT event_type, lane, queries, retry_rate, clarification_rate, p50, p95, p99, clarification_rate > 0.25 AS clarification_alert FROM g""")
def kpi_rollup(c):
    """Query-log KPIs with subtotals by event type and lane."""
    k = logs.query_kpis(c.query_logs().withColumn("lane_", F.col("lane")), "event_type", "lane_")
    return k.select(
        F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce("lane_", F.lit("*")).alias("lane"), "queries", "retry_rate", "clarification_rate", "p50", "p95", "p99", "clarification_alert"
    )


@query("A31", with_(S.QUERY_LOGS) + """, l AS (SELECT clarified, k % 2 = 0 AS skipped, value < 100 AS success, retry_count > 0 AS retried, CASE WHEN k % 5 = 0 THEN 'other' ELSE 'option' END AS choice FROM query_logs),
f AS (SELECT CASE WHEN clarified AND skipped AND success THEN 1 WHEN NOT clarified AND retried THEN 2 WHEN clarified AND choice = 'other' THEN 3 ELSE 0 END AS e FROM l)
SELECT count(*) AS logs, count(*) FILTER (e = 1) AS false_positive, count(*) FILTER (e = 2) AS false_negative, count(*) FILTER (e = 3) AS bad_options, round(count(*) FILTER (e = 1) / count(*), 6) AS false_positive_rate, round(count(*) FILTER (e = 2) / count(*), 6) AS false_negative_rate FROM f""")
def clarification_errors(c):
    """Error kinds and rates of the clarification step."""
    rows = c.query_logs().select(
        "clarified", (mod("k", 2) == 0).alias("skipped"), (F.col("value") < 100).alias("success"), (F.col("retry_count") > 0).alias("retried"),
        F.when(mod("k", 5) == 0, "other").otherwise("option").alias("choice"),
    )
    return logs.clarification_rates(rows)


@query("A31", with_(S.QUERY_LOGS) + """, g AS (SELECT user_id, k, count(*) AS frequency, round(avg((value < 60)::INT), 6) AS quality FROM query_logs WHERE clarified GROUP BY 1, 2)
SELECT user_id, k, frequency, quality, CASE WHEN quality > 0.7 AND frequency >= 3 THEN 'auto' WHEN quality BETWEEN 0.5 AND 0.7 OR frequency = 2 THEN 'review' WHEN quality < 0.5 OR frequency < 2 THEN 'reject' ELSE 'none' END AS tier FROM g""")
def example_tiers(c):
    """What happens to wrongly clarified questions."""
    g = c.query_logs().where("clarified").groupBy("user_id", "k").agg(F.count("*").alias("frequency"), F.round(F.avg((F.col("value") < 60).cast("double")), 6).alias("quality"))
    return g.withColumn("tier", logs.example_tier(F.col("quality"), F.col("frequency")))


@query("A32", with_(S.QUERY_LOGS) + """, i AS (SELECT (['transformer', 'transformr', 'breaker', 'xq', 'cable tray'])[CAST(k % 5 AS INTEGER) + 1] AS user_input, 'q' || (user_id % 40) AS original_query, value < 60 AS ok FROM query_logs WHERE clarified),
g AS (SELECT user_input, original_query, count(*) AS frequency, avg(ok::INT) AS ok FROM i GROUP BY 1, 2), d AS (SELECT * FROM (VALUES ('transformer'), ('breaker'), ('cable')) t(term)),
s AS (SELECT DISTINCT user_input FROM g JOIN d ON lower(left(user_input, 2)) = lower(left(term, 2)) AND levenshtein(user_input, term) <= 2),
c AS (SELECT g.*, round(least(1.0::DOUBLE, CASE WHEN frequency >= 5 THEN 0.4 WHEN frequency >= 3 THEN 0.2 ELSE 0 END + ok * 0.3 + CASE WHEN user_input IN (SELECT user_input FROM s) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(user_input, '^[a-z]{4,}$') THEN 0.1 ELSE 0 END), 6) AS confidence FROM g)
SELECT user_input, original_query, frequency, confidence, CASE WHEN frequency >= 5 AND confidence > 0.8 THEN 'auto_add' WHEN frequency <= 2 OR confidence < 0.3 THEN 'reject' ELSE 'review' END AS tier FROM c""")
def term_mining(c):
    """New terms from custom inputs, rated."""
    from docloom.plans.text_queries import pick

    inputs = c.query_logs().where("clarified").select(
        pick("k", ["transformer", "transformr", "breaker", "xq", "cable tray"]).alias("user_input"), F.concat(F.lit("q"), mod("user_id", 40).cast("string")).alias("original_query"), (F.col("value") < 60).alias("success"),
    )
    dictionary = c.spark.createDataFrame([("transformer",), ("breaker",), ("cable",)], "term string")
    return logs.mine_terms(inputs, dictionary, "^[a-z]{4,}$")


@query("A35", with_(S.QUERIES) + ", t AS (SELECT DISTINCT p_type AS term FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT 'tion') SELECT count(*) AS questions, round(avg((SELECT count(*) > 0 FROM t WHERE contains(query_text, term))::INT), 6) AS coverage FROM queries".replace("(SELECT count(*) > 0 FROM t WHERE contains(query_text, term))::INT", "coalesce(h, 0)").replace("FROM queries", "FROM queries LEFT JOIN (SELECT DISTINCT query_id, 1 AS h FROM queries, t WHERE contains(query_text, term)) USING (query_id)"))
def term_coverage(c):
    """Share of questions holding a dictionary term."""
    p = c.table("part")
    terms = p.select(F.col("p_type").alias("term")).unionByName(p.select(F.split("p_name", " ")[0].alias("term"))).distinct()
    terms = terms.unionByName(c.spark.createDataFrame([("tion",)], "term string"))
    return logs.term_coverage(c.queries(), terms)


@query("A33", """WITH cs AS (SELECT o_orderkey AS case_id, o_custkey AS expected_doc FROM orders WHERE o_orderstatus = 'F'), kd AS (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 4 <> 0),
pr AS (SELECT c_custkey AS expected_doc, c_custkey % 50 AS chunk_id FROM customer), rt AS (SELECT l_orderkey AS case_id, l_partkey % 50 AS chunk_id FROM lineitem),
h AS (SELECT DISTINCT case_id FROM cs JOIN rt USING (case_id) JOIN pr USING (expected_doc, chunk_id))
SELECT case_id, expected_doc, CASE WHEN expected_doc NOT IN (SELECT doc_id FROM kd) THEN 'missing_doc' WHEN case_id NOT IN (SELECT case_id FROM h) THEN 'embedding' ELSE 'reranking' END AS root_cause FROM cs""")
def bad_case_causes(c):
    """Root cause of every failed question."""
    cases = c.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("expected_doc"))
    known = c.table("customer").where(mod("c_custkey", 4) != 0).select(F.col("c_custkey").alias("doc_id"))
    parents = c.table("customer").select(F.col("c_custkey").alias("expected_doc"), mod("c_custkey", 50).alias("chunk_id"))
    retrieved = c.table("lineitem").select(F.col("l_orderkey").alias("case_id"), mod("l_partkey", 50).alias("chunk_id"))
    return logs.bad_case_causes(cases, known, parents, retrieved)


@query("A39", with_(S.QUERY_LOGS) + """, l AS (SELECT user_id, k, lane, arg_max(feedback_score, (created_at, query_log_id)) AS s FROM query_logs GROUP BY 1, 2, 3)
SELECT lane, count(*) AS rated, round(avg(s), 6) AS mean_score FROM l GROUP BY 1""")
def feedback_scores(c):
    """Mean of the latest score per user and question, by lane."""
    rows = c.query_logs().withColumn("q", F.struct("user_id", "k"))
    return logs.latest_feedback(rows, "q", ["created_at", "query_log_id"], "feedback_score", ["lane"])


@query("A37", with_(S.QUERY_LOGS) + "SELECT query_log_id, lane FROM query_logs WHERE retry_count > 0 OR feedback_score <= 2 OR (query_log_id * 37 + 11) % 100 < 10")
def log_sample(c):
    """All abnormal queries and a tenth of the others."""
    abnormal = (F.col("retry_count") > 0) | (F.col("feedback_score") <= 2)
    return logs.sample_logs(c.query_logs(), "query_log_id", abnormal, hashed=F.col("query_log_id") * 37 + 11).select("query_log_id", "lane")
