"""Registered streaming queries; each runs over the stored files as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.sql_tables import with_
from docloom.plans.text_queries import mod
from docloom.session import shared_dir
from docloom.sources.tables import prop_k
from docloom.streaming import jobs


def fresh_folders(c, name):
    """Output and checkpoint folders of one run, in the shared folder."""
    base = f"{shared_dir(c.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def log_stream(c):
    """The query log of a stored table, in one batch: its files overlap in time, and no row of it is late."""
    kind = F.col("event_type")
    return jobs.table_stream(c.spark, c.folder, "events", files_per_trigger=None).select(
        F.col("event_id").alias("query_log_id"), "user_id", F.when(kind.isin("error", "signup"), "slow").otherwise("fast").alias("lane"), (kind == "signup").alias("clarified"),
        (kind == "error").cast("int").alias("retry_count"), F.floor(F.col("value") * 10).cast("long").alias("total_time"), F.col("ts").cast("timestamp").alias("created_at"), prop_k(F.col("props")).alias("k"),
    )


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("X2", with_(S.QUERY_LOGS) + """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('hour', created_at) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS queries, CAST(sum((lane = 'slow')::INT) AS BIGINT) AS slow,
  CAST(sum(retry_count) AS BIGINT) AS retries, CAST(sum(clarified::INT) AS BIGINT) AS clarified, max(total_time) AS slowest, sum(clarified::INT) / count(*) > 0.25 AS clarification_alert FROM query_logs GROUP BY date_trunc('hour', created_at)""")
def stream_kpi(c):
    """Hourly KPIs of the query log as a stream."""
    out, state = fresh_folders(c, "kpi")
    done = jobs.run_batches_latest(jobs.kpi_windows(log_stream(c)), out, state, ["window_start", "window_end"])
    return done.select(stamp("window_start"), stamp("window_end"), "queries", "slow", "retries", "clarified", "slowest", "clarification_alert")


@query("X1", "SELECT event_type || '-' || user_id AS upload, count(*) > 0 AS stored FROM events GROUP BY 1")
def stream_dedup(c):
    """Uploads stored once per content key; keys seen are state of the stream."""
    out, state = fresh_folders(c, "uploads")
    uploads = jobs.table_stream(c.spark, c.folder, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("upload"))
    with jobs.state_on_disk(c.spark):
        stored = jobs.run_to_table(jobs.first_uploads(uploads, "upload"), out, state)
    return stored.select("upload", F.lit(True).alias("stored"))


@query("X3", """WITH RECURSIVE r AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS t FROM events),
n AS (SELECT k, t, min(t) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM r),
o AS (SELECT k, min(t) AS t FROM r GROUP BY k UNION ALL SELECT n.k, n.nt FROM o JOIN n ON o.k = n.k AND o.t = n.t WHERE n.nt IS NOT NULL)
SELECT k, strftime(t, '%Y-%m-%d %H:%M:%S') AS opened_at FROM o""")
def stream_ttl(c):
    """Requests that open a cache entry: none of the same key is younger than six hours."""
    out, state = fresh_folders(c, "ttl")
    opened = jobs.fresh_answers(log_stream(c), "k", "created_at", "6 hours")
    return jobs.run_to_table(opened, out, state).select("k", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("opened_at"))


@query("X4", with_(S.QUERY_LOGS) + """, g AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM query_logs WINDOW w AS (PARTITION BY user_id ORDER BY created_at)), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(created_at) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS queries, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM s GROUP BY user_id, s""")
def stream_sessions(c):
    """Sessions of every user as a stream: those the watermark has closed, and at the end of the table those still open."""
    out, state = fresh_folders(c, "sessions")
    closed = jobs.run_to_table(jobs.activity_sessions(log_stream(c), gap="6 hours"), out, state)
    done = closed.unionByName(jobs.open_sessions(c.spark, state))
    return done.select("user_id", stamp("session_start"), stamp("session_end"), "queries", stamp("last_at"))


@query("X5", """SELECT o_custkey AS doc_id, count(*) AS pages FROM orders GROUP BY 1""")
def stream_complete(c):
    """Documents reported once all their pages have arrived."""
    out, state = fresh_folders(c, "pages")
    orders = c.table("orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("_lo"), F.count("*").alias("page_count"))
    rank = orders.select("o_custkey", "o_orderkey").join(first, "o_custkey")
    from pyspark.sql import Window

    # Page numbers are prepared as a table of files, which the stream then reads.
    pages = rank.select("o_custkey", "page_count", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("page_idx"))
    pages.select(F.col("o_custkey").alias("doc_id"), "page_idx", "page_count").repartition(4, "page_idx").write.parquet(f"{out}-in")
    stream = c.spark.readStream.schema("doc_id long, page_idx long, page_count long").option("maxFilesPerTrigger", 2).parquet(f"{out}-in")
    return jobs.run_to_table(jobs.complete_documents(stream), out, state)


@query("X6", """SELECT o_orderkey AS task_id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_tasks(c):
    """Orders without a completing item, to be handed in again."""
    submitted = c.table("orders").select(F.col("o_orderkey").alias("task_id"), "o_custkey")
    return jobs.pending_tasks(submitted, c.table("lineitem").select(F.col("l_orderkey").alias("task_id"), "l_returnflag"), status=F.col("l_returnflag") == "R")


@query("X7", """WITH ch AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), st AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN ch ON l_partkey % 1500 = c_custkey)
SELECT l_orderkey AS entry_id, l_partkey % 1500 AS doc_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM st)""")
def cache_invalidation(c):
    """Cache entries none of whose documents changed."""
    cache = c.table("lineitem").select(F.col("l_orderkey").alias("entry_id"), mod("l_partkey", 1500).alias("doc_id"), "l_linenumber")
    return jobs.drop_stale_entries(cache, c.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("doc_id")))


@query("X7", """SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def stream_live_requests(c):
    """Streamed requests whose document did not change."""
    out, state = fresh_folders(c, "live")
    requests = jobs.table_stream(c.spark, c.folder, "events").select("event_id", "user_id")
    changed = c.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return jobs.run_to_table(jobs.live_requests(requests, changed, "user_id").select("event_id", "user_id"), out, state)
