from pyspark.sql import functions as F

from docloom.sources import files, stores
from docloom.streaming import jobs


def test_directory_scan_skips_known_hashes(spark, tmp_path):
    for name, body in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.pdf", b"two"), ("d.txt", b"three")):
        (tmp_path / name).write_bytes(body)
    found = files.scan_files(spark, str(tmp_path))
    known = found.where("name = 'c.pdf'").select("file_hash")
    report = {r["name"]: r["status"] for r in files.ingest_report(found, known).collect()}
    assert report == {"a.pdf": "ingested", "b.pdf": "duplicate", "c.pdf": "duplicate"}


def test_ingest_writes_three_stores(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "alpha beta alpha"), (2, 1, "beta")], "chunk_id long, doc_id long, content string")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0)).alias("vector"))
    counts = stores.write_ingest(stores.ingest_tables(chunks, vectors), str(tmp_path / "s"), buckets=2)
    assert {r["store"]: r["rows"] for r in counts.collect()} == {"chunks": 2, "vectors": 2, "postings": 3}


def test_upload_stream_is_idempotent(spark, tmp_path):
    """Over batches, over a restart with new files, and when nothing new is there."""
    add = lambda *names: spark.createDataFrame([(n,) for n in names], "file_hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def ingested():
        stream = spark.readStream.schema("file_hash string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with jobs.state_on_disk(spark):
            return sorted(r[0] or "-" for r in jobs.run_to_table(jobs.first_uploads(stream, "file_hash"), str(tmp_path / "out"), str(tmp_path / "ck")).collect())

    for i in range(3):
        add(f"h{i}", "same")
    assert ingested() == ["h0", "h1", "h2", "same"] == ingested()
    add("h1", "h3", None, None)
    assert ingested() == ["-", "h0", "h1", "h2", "h3", "same"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == "" or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_sessions_still_open_come_from_the_state(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 09:00:00"), ("b", "2024-01-01 08:50:00")]
    spark.createDataFrame(rows, "user_id string, t string").select("user_id", F.to_timestamp("t").alias("created_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, created_at timestamp").parquet(str(tmp_path / "in"))
    closed = jobs.run_to_table(jobs.activity_sessions(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    held = jobs.open_sessions(spark, str(tmp_path / "ck"))
    show = lambda df: sorted((r.user_id, r.session_start.strftime("%H:%M"), r.queries) for r in df.collect())
    assert show(closed) == [("a", "00:00", 2)] and show(held) == [("a", "09:00", 1), ("b", "08:50", 1)] and held.columns == closed.columns
