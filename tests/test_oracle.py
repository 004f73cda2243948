"""Every registered query against its SQL on the smallest tables."""

import os
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.plans import registry  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # has more events than the files they are dealt over
SQL = registry.oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    left = registry.runnable()[name](spark, FOLDER).toPandas()
    assert compare(left, duck.execute(SQL[name]).df()).startswith("ok")


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    """The events dealt over 2,010 files, each of which spans the whole time range."""
    folder = tmp_path_factory.mktemp("events")
    (folder / "events.parquet").mkdir()
    events = pq.read_table(f"{LARGER}/events.parquet").sort_by("ts")
    for i in range(2010):
        path = folder / "events.parquet" / f"part-{i:05}.parquet"
        pq.write_table(events.take(list(range(i, len(events), 2010))), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes files by age
    return str(folder)


@pytest.mark.parametrize("name", ["stream_kpi", "stream_sessions", "stream_ttl"])
def test_stream_over_files_that_overlap_in_time(spark, many_files, name):
    left = registry.runnable()[name](spark, many_files).toPandas()
    assert compare(left, connect(LARGER).execute(SQL[name]).df()).startswith("ok")
