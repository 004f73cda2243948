"""Structured Streaming forms of the incremental work: ingest, monitoring, sessions, expiry.

Every stateful job has a watermark, so its state is bounded by the data that can still
change, not by the history of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = 1000) -> DataFrame:
    """Stream of a Parquet table's files; the schema is taken from the stored files.

    Without ``files_per_trigger`` an available-now run reads all files in one batch. A job with a
    watermark needs that where files overlap in time: part files of one table each span its whole
    time range, and after a first batch of some of them the rows of the others would count as late.

    A table is a folder of part files, or one file; a stream reads a folder, so a single file is
    named by a pattern that only it matches.
    """
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the files of a table lie below its path."""
    listed = spark.read.parquet(path).select(F.col("_metadata.file_path")).limit(1).collect()
    return bool(listed) and not listed[0][0].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1])


def run_to_table(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder, and read the folder back."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)


def run_batches(stream: DataFrame, function, checkpoint: str) -> None:
    """Run ``function(batch, batch_id)`` over what is there now."""
    stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches_latest(stream: DataFrame, output: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregation in update mode over what is there now; the last state of each group of ``keys``.

    Every batch writes the groups it changed under its own number, and the latest batch
    wins, so windows still open at the end are part of the result.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    stored = stream.sparkSession.read.parquet(output)
    latest = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("_v")
    return stored.groupBy(*keys).agg(latest).select(*keys, "_v.*").select(stream.columns)


# ---------------------------------------------------------------- X1
def first_uploads(stream: DataFrame, key: str) -> DataFrame:
    """First upload of each key, whatever the batch or the restart it comes in.

    The keys seen are keyed state of the stream's checkpoint, so a batch looks up its own keys and
    nothing of what has been stored before is read again; a batch that is repeated after a
    failure writes the same rows. Uploads without a key count as one. Run it with
    :func:`state_on_disk`, as the keys of a long history do not fit into memory.
    """
    return stream.dropDuplicates([key])


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB and send its changes, not snapshots, to the checkpoint."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# ---------------------------------------------------------------- X2
def kpi_windows(logs: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK, alert: float = 0.25) -> DataFrame:
    """Counts, lane share, retry and clarification rate per time window, with an alert flag."""
    window = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    timed = logs.withWatermark("created_at", watermark) if logs.isStreaming else logs
    out = timed.groupBy(window.alias("w")).agg(
        F.count("*").alias("queries"), F.sum((F.col("lane") == "slow").cast("long")).alias("slow"), F.sum(F.col("retry_count").cast("long")).alias("retries"),
        F.sum(F.col("clarified").cast("long")).alias("clarified"), F.max("total_time").alias("slowest"),
    )
    return out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "queries", "slow", "retries", "clarified", "slowest",
        (F.col("clarified") / F.col("queries") > alert).alias("clarification_alert"),
    )


# ---------------------------------------------------------------- X3
def fresh_answers(requests: DataFrame, key: str, time: str, ttl: str = "6 hours", watermark: str = WATERMARK) -> DataFrame:
    """Requests that open a cache entry: rows (key, time).

    An entry lives for ``ttl`` from its opening, by event time; the first request at or after its
    end opens the next one. The state of a key is its last opening, and it goes when the watermark
    has passed the entry's end.
    """
    lives = pd.Timedelta(ttl)
    timed = requests.select(key, time).withWatermark(time, watermark)

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([b[time] for b in batches]).sort_values()
        opened = [pd.Timestamp(state.get[0])] if state.exists else []
        known, at = len(opened), 0
        while at < len(times):
            at = int(times.searchsorted(opened[-1] + lives)) if opened else 0
            if at < len(times):
                opened.append(times.iloc[at])
        state.update((opened[-1].to_pydatetime(),))
        state.setTimeoutTimestamp(max(int((opened[-1] + lives).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * (len(opened) - known), time: opened[known:]})

    types = dict(timed.dtypes)
    return timed.groupBy(key).applyInPandasWithState(
        update, f"`{key}` {types[key]}, `{time}` timestamp", "opened timestamp", "append", GroupStateTimeout.EventTimeTimeout
    )


# ---------------------------------------------------------------- X4
def activity_sessions(logs: DataFrame, by: str = "user_id", time: str = "created_at", gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Sessions of activity: start, end and number of queries.

    In a stream a session is given out when the watermark has passed its end, and its state goes.
    """
    timed = logs.withWatermark(time, watermark) if logs.isStreaming else logs
    out = timed.groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("queries"), F.max(time).alias("last_at"))
    return out.select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "queries", "last_at")


def open_sessions(spark: SparkSession, checkpoint: str, by: str = "user_id") -> DataFrame:
    """Sessions that a stopped stream of :func:`activity_sessions` has not given out yet, from its state store."""
    held = spark.read.format("statestore").option("path", checkpoint).load().select("value.*")
    return held.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), F.col("count").alias("queries"), F.col("max").alias("last_at"))


# ---------------------------------------------------------------- X5
def complete_documents(pages: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Documents whose every page has arrived: rows (doc_id, pages).

    Pages carry doc_id, page_idx, page_count. The state of a document is a bitmap of its
    pages. It goes when the document is complete or, in a continuous run, stays silent for
    the timeout; a timeout keeps an available-now run from ending, so it is off by default.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bits, total = state.get if state.exists else (b"", 0)
        seen = int.from_bytes(bits, "little")
        for batch in batches:
            total = int(batch["page_count"].iloc[0])
            for page in batch["page_idx"]:
                seen |= 1 << int(page)
        if total and seen.bit_count() >= total:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "pages": [total]})
        else:
            state.update((seen.to_bytes((seen.bit_length() + 7) // 8, "little"), total))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)

    return pages.select("doc_id", "page_idx", "page_count").groupBy("doc_id").applyInPandasWithState(
        update, "doc_id long, pages long", "bits binary, total long", "append",
        GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


# ---------------------------------------------------------------- X6
def pending_tasks(submitted: DataFrame, completed: DataFrame, key: str = "task_id", status: Column | None = None) -> DataFrame:
    """Submitted tasks without a completion, to be handed in again."""
    done = completed if status is None else completed.where(status)
    return submitted.join(done.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- X7
def drop_stale_entries(cache: DataFrame, changed: DataFrame, entry: str = "entry_id", document: str = "doc_id") -> DataFrame:
    """Cache rows none of whose documents changed; one entry refers to several documents."""
    stale = cache.join(changed.select(document).distinct(), document, "left_semi").select(entry).distinct()
    return cache.join(stale, entry, "left_anti")


def live_requests(requests: DataFrame, changed: DataFrame, document: str = "doc_id") -> DataFrame:
    """Stream of requests against a static table of changed documents: those still answerable from cache."""
    return requests.join(changed.select(document).distinct(), document, "left_anti")
