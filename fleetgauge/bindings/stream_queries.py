"""Streaming jobs over the events table, read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import bind
from fleetgauge.streaming import jobs


def _feed(t):
    # a glob, so that the table may be one file or a folder of files
    return t.spark.readStream.schema(t.events.schema).parquet(t.path("events")[:-1] + "*")


@bind("stm1_stream_error_counts", """
SELECT event_type AS error_class, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS lines FROM events GROUP BY 1, 2
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stm1(t):
    return jobs.run_to_table(jobs.stream_error_counts(_feed(t), "ts", F.col("event_type")), "stm1")


_SILENT = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, max(ts) + INTERVAL 6 HOUR AS silent_since_limit, count(*) AS events FROM s GROUP BY user_id, n
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


@bind("stm2_stream_gap_alerts", _SILENT)
def stm2(t):
    return jobs.run_to_table(jobs.stream_gap_alerts(_feed(t), ["user_id"], "ts"), "stm2")


@bind("stm2_batch_gap_alerts", _SILENT)
def stm2b(t):
    return jobs.batch_gap_alerts(t.events, ["user_id"], "ts")
