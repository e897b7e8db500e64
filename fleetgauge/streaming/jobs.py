"""Streaming jobs on log and event feeds, and their batch forms.

Both forms report what the watermark has closed: with the watermark at (latest event time
- delay), a window or a silence counts once its end is not after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.numbers import row_count
from fleetgauge.operators.windows import sessions
from fleetgauge.session import scratch_dir


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; zone-less times are read as session time."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def stream_error_counts(sdf: DataFrame, ts: str, cls: Column, window: str = "1 hour", late: str = "10 minutes",
                        by: Sequence[str] = ()) -> DataFrame:
    """Lines per class and tumbling window; lines later than the delay are dropped."""
    timed = _event_time(sdf, ts).withWatermark(ts, late)
    counted = timed.groupBy(F.window(ts, window).alias("w"), *by, cls.alias("error_class")).agg(row_count().alias("lines"))
    return _plain_times(counted.select(*by, "error_class", F.col("w.start").alias("window_start"),
                                       F.col("w.end").alias("window_end"), "lines"), "window_start", "window_end")


def batch_error_counts(df: DataFrame, ts: str, cls: Column, window: str = "1 hour", late: str = "10 minutes",
                       by: Sequence[str] = ()) -> DataFrame:
    timed = _event_time(df, ts)
    mark = timed.agg((F.max(ts) - F.expr(f"INTERVAL {late}")).alias("m")).scalar()
    counted = timed.groupBy(F.window(ts, window).alias("w"), *by, cls.alias("error_class")).agg(row_count().alias("lines"))
    closed = counted.filter(F.col("w.end") <= mark)
    return _plain_times(closed.select(*by, "error_class", F.col("w.start").alias("window_start"),
                                      F.col("w.end").alias("window_end"), "lines"), "window_start", "window_end")


def stream_gap_alerts(sdf: DataFrame, keys: Sequence[str], ts: str, limit: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """An alert each time an entity has been silent for longer than `limit`."""
    timed = _event_time(sdf, ts).withWatermark(ts, late)
    silent = timed.groupBy(F.session_window(ts, limit).alias("w"), *keys).agg(row_count().alias("events"), F.max(ts).alias("last_event"))
    return _plain_times(silent.select(*keys, F.col("w.start").alias("first_event"), "last_event",
                                      F.col("w.end").alias("silent_since_limit"), "events"),
                        "first_event", "last_event", "silent_since_limit")


def batch_gap_alerts(df: DataFrame, keys: Sequence[str], ts: str, limit: str = "6 hours", late: str = "10 minutes", hot_rows: int | None = None) -> DataFrame:
    """The same alerts from a table; the history of a hot entity is cut into ranges."""
    timed = _event_time(df, ts)
    mark = timed.agg((F.max(ts) - F.expr(f"INTERVAL {late}")).alias("m")).scalar()
    found = sessions(timed, keys, ts, limit, hot_rows).withColumn("silent_since_limit", F.col("last_event") + F.expr(f"INTERVAL {limit}"))
    closed = found.filter(F.col("silent_since_limit") <= mark)
    return _plain_times(closed.select(*keys, "first_event", "last_event", "silent_since_limit", "events"), "first_event", "last_event", "silent_since_limit")


def run_to_table(result: DataFrame, label: str, path: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Run a streaming result over what is available, to Parquet, and read it back.

    Output and checkpoint lie in the shared folder, so a lost driver can go on from there.
    """
    spark = result.sparkSession
    root = path or scratch_dir(spark, label)
    query = (result.writeStream.format("parquet").outputMode("append")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/out")
