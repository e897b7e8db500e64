"""Streaming and batch forms give the same answer, in one batch or in many."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.streaming import jobs
from tests.conftest import rows


@pytest.fixture(scope="module")
def feed(spark, small, tmp_path_factory):
    """The events in four files by time, read one file per batch."""
    root = tmp_path_factory.mktemp("feed")
    events = spark.read.parquet(f"{small}/events.parquet")
    for n, (lo, hi) in enumerate([(1, 8), (8, 15), (15, 22), (22, 32)]):
        part = events.filter((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < hi))
        part.coalesce(1).write.mode("append").parquet(f"{root}/f")
    return events, f"{root}/f"


def stream(spark, feed):
    events, path = feed
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_error_counts(spark, feed):
    got = jobs.run_to_table(jobs.stream_error_counts(stream(spark, feed), "ts", F.col("event_type"), "6 hours", "30 minutes"), "t1")
    want = jobs.batch_error_counts(feed[0], "ts", F.col("event_type"), "6 hours", "30 minutes")
    assert rows(got, *want.columns) == rows(want) and want.count() > 0


def test_gap_alerts(spark, feed):
    got = jobs.run_to_table(jobs.stream_gap_alerts(stream(spark, feed), ["user_id"], "ts", "3 hours"), "t2")
    want = jobs.batch_gap_alerts(feed[0], ["user_id"], "ts", "3 hours")
    assert rows(got, *want.columns) == rows(want) and want.count() > 0


def test_a_query_goes_on_from_its_checkpoint(spark, feed, tmp_path):
    events, path = feed
    result = lambda: jobs.stream_error_counts(stream(spark, feed), "ts", F.col("event_type"), "1 day", "1 hour")
    first = jobs.run_to_table(result(), "t3", str(tmp_path))
    assert rows(jobs.run_to_table(result(), "t3", str(tmp_path))) == rows(first)
