"""Ready-made checks on landing tables projected from the supplied ones, three servers each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.bindings.registry import EVENTS_NOW, bind, cents
from fleetgauge.plans.checks import run_check
from fleetgauge.session import write_once
from fleetgauge.sources.schemas import landing_schema


def landed(df: DataFrame, table: str, **columns: Column | str) -> DataFrame:
    """A landing table from expressions over `df`; columns that are not given are NULL."""
    given = {k: F.expr(v) if isinstance(v, str) else v for k, v in {"collected_at": "TIMESTAMP '2024-02-01 00:00:00'", **columns}.items()}
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in landing_schema(table)])


def _server(column: str) -> str:
    return f"concat('srv', cast({column} % 3 AS string))"


def _databases(t) -> DataFrame:
    """A database per user of the events; every other one in full recovery."""
    return landed(t.events.select("user_id").distinct(), "dim_database", sql_instance=_server("user_id"), database_id="user_id + 5", database_name="concat('db', cast(user_id AS string))",
                  state_desc="'ONLINE'", recovery_model="CASE WHEN user_id % 2 = 0 THEN 'FULL' ELSE 'SIMPLE' END")


def _backups(t) -> DataFrame:
    return landed(t.events, "fact_backup", sql_instance=_server("user_id"), backup_set_id="event_id", database_name="concat('db', cast(user_id AS string))",
                  type="CASE event_type WHEN 'signup' THEN 'D' WHEN 'purchase' THEN 'I' WHEN 'view' THEN 'L' ELSE 'F' END", start_date="ts", finish_date="ts", backup_size="CAST(floor(value) AS BIGINT)",
                  first_lsn="event_id", last_lsn="event_id + 1", differential_base_lsn="event_id % 50", is_copy_only="event_id % 7 = 0", recovery_model="'FULL'", device_name="event_type")


_DB = "SELECT DISTINCT 'srv' || (user_id % 3) AS sql_instance, 'db' || user_id AS database_name, CASE WHEN user_id % 2 = 0 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model, user_id FROM events"


@bind("chk13_01_backup_coverage", f"""
WITH db AS ({_DB}), l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'signup') AS f, max(ts) FILTER (WHERE event_type = 'purchase') AS d, max(ts) FILTER (WHERE event_type = 'view') AS g FROM events GROUP BY 1)
SELECT sql_instance, database_name, f AS last_full, d AS last_diff, g AS last_log, CASE WHEN f IS NULL THEN 1 ELSE 0 END AS flag_no_backup,
  CASE WHEN recovery_model = 'FULL' AND (g IS NULL OR g < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR) THEN 1 ELSE 0 END AS flag_no_recent_log FROM db JOIN l USING (user_id)""")
def chk13_01(t):
    found = run_check("13_01", {"dim_database": _databases(t), "fact_backup": _backups(t)}, EVENTS_NOW)["databases"]
    return found.select("sql_instance", "database_name", "last_full", "last_diff", "last_log", "flag_no_backup", "flag_no_recent_log")


@bind("chk13_03_recovery_point", f"""
WITH db AS ({_DB}), g AS (SELECT user_id, ts, date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events WHERE event_type = 'view'),
 s AS (SELECT user_id, sum(gap) AS total, count(gap) AS n, max(gap) AS max_gap FROM g WHERE gap IS NOT NULL GROUP BY 1),
 e AS (SELECT user_id, max(ts) AS last_event FROM g WHERE gap IS NOT NULL GROUP BY 1),
 j AS (SELECT *, date_diff('minute', last_event, TIMESTAMP '{EVENTS_NOW}') AS m FROM db LEFT JOIN s USING (user_id) LEFT JOIN e USING (user_id))
SELECT sql_instance, database_name, max_gap, m AS minutes_since_last, CASE WHEN recovery_model = 'FULL' AND max_gap > 60 THEN 1 ELSE 0 END AS flag_missed_window,
  CASE WHEN recovery_model = 'FULL' AND (last_event IS NULL OR m * n > total) THEN 1 ELSE 0 END AS flag_exposed, CASE WHEN recovery_model = 'FULL' AND last_event IS NULL THEN 1 ELSE 0 END AS flag_no_event FROM j""")
def chk13_03(t):
    found = run_check("13_03", {"dim_database": _databases(t), "fact_backup": _backups(t)}, EVENTS_NOW)["databases"]
    return found.select("sql_instance", "database_name", F.col("max_gap").cast("bigint").alias("max_gap"), F.col("minutes_since_last").cast("bigint").alias("minutes_since_last"), "flag_missed_window", "flag_exposed", "flag_no_event")


@bind("chk10_01_blocking", f"""
WITH s AS (SELECT 'srv' || (c_nationkey % 3) AS sql_instance, c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 4 ELSE 0 END AS blocker, abs({cents('c_acctbal')}) AS ms, c_mktsegment AS login FROM customer)
SELECT s.sql_instance, s.session_id::INTEGER AS session_id, s.blocker::INTEGER AS blocking_session_id, s.login AS login_name, b.login AS blocker_login_name, s.ms / 1000.0 AS wait_sec
FROM s LEFT JOIN s b ON b.sql_instance = s.sql_instance AND b.session_id = s.blocker WHERE s.blocker > 0""")
def chk10_01(t):
    sessions = landed(t.customer, "fact_session", sql_instance=_server("c_nationkey"), session_id="c_custkey", blocking_session_id="CASE WHEN c_custkey % 2 = 0 THEN c_custkey div 4 ELSE 0 END",
                      wait_ms="abs(CAST(round(c_acctbal * 100) AS BIGINT))", login_name="c_mktsegment")
    return run_check("10_01", {"fact_session": sessions}, EVENTS_NOW)["pairs"]


def _index_columns(t) -> DataFrame:
    """Orders as indexes of their customer's table, the flags of their lines as key columns."""
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
    return landed(rows, "fact_index_column", sql_instance=_server("o_custkey"), database_name="'shop'", object_id="o_custkey", index_id="l_orderkey", index_name="concat('ix_', cast(l_orderkey AS string))",
                  key_ordinal="l_linenumber", column_name="l_returnflag", is_descending_key="l_linestatus = 'F'", is_included_column="l_linenumber = 7", filter_definition="o_orderstatus")


_KEYS = """k AS (SELECT * FROM (SELECT 'srv' || (o_custkey % 3) AS sql_instance, o_custkey AS object_id, l_orderkey, o_orderstatus AS flt,
   coalesce(string_agg(l_returnflag || CASE l_linestatus WHEN 'F' THEN ':DESC' ELSE ':ASC' END, ',' ORDER BY l_linenumber, l_returnflag || CASE l_linestatus WHEN 'F' THEN ':DESC' ELSE ':ASC' END) FILTER (WHERE l_linenumber <> 7), '') AS keys,
   coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE l_linenumber = 7), '') AS inc
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) WHERE keys <> '')"""


@bind("chk11_04_duplicate_indexes", f"""
WITH {_KEYS}, p AS (SELECT a.sql_instance, a.object_id::INTEGER AS object_id, a.l_orderkey::INTEGER AS index_1, b.l_orderkey::INTEGER AS index_2, CASE WHEN a.keys = b.keys AND a.inc = b.inc AND a.flt = b.flt THEN 'EXACT_DUPLICATE'
   WHEN b.keys LIKE a.keys || ',%' THEN 'INDEX1_IS_PREFIX' WHEN a.keys LIKE b.keys || ',%' THEN 'INDEX2_IS_PREFIX' END AS duplicate_type FROM k a JOIN k b ON a.object_id = b.object_id AND a.l_orderkey < b.l_orderkey)
SELECT * FROM p WHERE duplicate_type IS NOT NULL""")
def chk11_04(t):
    return run_check("11_04", {"fact_index_column": write_once(_index_columns(t), "index-columns")}, EVENTS_NOW)["pairs"].drop("database_name")


@bind("chk12_03_duplicate_statistics", """
WITH s AS (SELECT 'srv' || (o_custkey % 3) AS sql_instance, o_custkey AS object_id, l_orderkey AS id, o_orderstatus AS flt, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS list FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT a.sql_instance, a.object_id::INTEGER AS object_id, min(a.id)::INTEGER AS stat_1, b.id::INTEGER AS stat_2, a.list AS column_list, CASE WHEN a.list = b.list AND a.flt = b.flt THEN 'EXACT_DUPLICATE' ELSE 'OVERLAPPING_PREFIX' END AS duplicate_type
FROM s a JOIN s b ON a.object_id = b.object_id AND b.id > a.id AND starts_with(b.list, a.list) GROUP BY a.sql_instance, a.object_id, b.id, a.list, b.list, a.flt, b.flt""")
def chk12_03(t):
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
    columns = landed(rows, "fact_stats_column", sql_instance=_server("o_custkey"), database_name="'shop'", object_id="o_custkey", stats_id="l_orderkey", ordinal="l_linenumber", column_name="l_returnflag", filter_definition="o_orderstatus")
    return run_check("12_03", {"fact_stats_column": write_once(columns, "stats-columns")}, EVENTS_NOW)["links"].drop("set_size", "database_name")


@bind("chk17_05_alert_gaps", """
WITH a AS (SELECT 'srv' || (n_nationkey % 3) AS sql_instance, n_regionkey % 2 AS enabled, 17 + n_nationkey % 10 AS severity, CASE WHEN n_nationkey % 5 = 0 THEN 823 ELSE 0 END AS message_id FROM nation),
 w AS (SELECT DISTINCT 'srv' || (r_regionkey % 3) AS sql_instance, unnest(range(19, 26))::INTEGER AS severity FROM region)
SELECT sql_instance, severity, 'ACTUAL' AS row_kind FROM a
UNION ALL SELECT sql_instance, severity, 'MISSING' FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sql_instance = w.sql_instance AND a.severity = w.severity AND enabled = 1 AND message_id = 0)""")
def chk17_05(t):
    alerts = landed(t.nation, "fact_alert", sql_instance=_server("n_nationkey"), alert_id="n_nationkey", enabled="n_regionkey % 2", severity="17 + n_nationkey % 10", message_id="CASE WHEN n_nationkey % 5 = 0 THEN 823 ELSE 0 END")
    servers = landed(t.region.select((F.col("r_regionkey") % 3).alias("r")).distinct(), "dim_instance", sql_instance=_server("r"))
    found = run_check("17_05", {"fact_alert": alerts, "dim_instance": servers}, EVENTS_NOW)["severities"]
    return found.select("sql_instance", "severity", F.when(F.col("row_kind") == "ACTUAL", "ACTUAL").otherwise("MISSING").alias("row_kind"))


@bind("chk08_01_wait_totals", f"""
SELECT 'srv' || (l_suppkey % 3) AS sql_instance, l_returnflag || l_linestatus AS wait_type, collected_at, wait_delta, flag_restart FROM (
 SELECT l_suppkey, l_returnflag, l_linestatus, l_shipdate AS collected_at, wait_ms, lag(wait_ms) OVER w AS p, CASE WHEN wait_ms < lag(wait_ms) OVER w THEN 1 ELSE 0 END AS flag_restart,
  CASE WHEN lag(wait_ms) OVER w IS NULL THEN NULL WHEN wait_ms < lag(wait_ms) OVER w THEN wait_ms ELSE wait_ms - lag(wait_ms) OVER w END AS wait_delta
 FROM (SELECT min(l_suppkey) AS l_suppkey, l_suppkey % 3 AS srv, l_returnflag, l_linestatus, l_shipdate, sum({cents('l_extendedprice')})::BIGINT AS wait_ms FROM lineitem GROUP BY 2, 3, 4, 5)
 WINDOW w AS (PARTITION BY srv, l_returnflag, l_linestatus ORDER BY l_shipdate))""")
def chk08_01(t):
    waits = t.lineitem.groupBy((F.col("l_suppkey") % 3).alias("s"), F.concat("l_returnflag", "l_linestatus").alias("w"), "l_shipdate").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("ms"))
    table = landed(waits, "fact_wait", sql_instance=_server("s"), wait_type="w", tasks="ms", wait_ms="ms", signal_ms="0", max_wait_ms="0", started_at="TIMESTAMP_NTZ '2024-01-01 00:00:00'", collected_at="CAST(l_shipdate AS TIMESTAMP)")
    found = run_check("08_01", {"fact_wait": table}, EVENTS_NOW)["deltas"]
    return found.select("sql_instance", "wait_type", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"), "wait_delta", "flag_restart")
