"""Every ready-made check runs on its landing tables, and some are followed in detail."""

import datetime as dt
from decimal import Decimal

import pytest

from fleetgauge.plans.checks import CHECKS, run_check
from fleetgauge.sources.schemas import LANDING, landing_schema
from tests.conftest import rows

NOW = "2024-03-01 12:00:00"
SEEN = dt.datetime(2024, 3, 1, 11)


def ts(text):
    return dt.datetime.fromisoformat(text)


def frame(spark, table, *items, server="s1"):
    """Rows given as dicts; columns left out are NULL."""
    schema = landing_schema(table)
    full = [tuple({"sql_instance": server, "collected_at": SEEN, **i}.get(n) for n in schema.names) for i in items]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def empty(spark):
    return {name: spark.createDataFrame([], landing_schema(name)) for name in LANDING}


@pytest.mark.parametrize("number", sorted(CHECKS))
def test_check_runs_on_empty_tables(empty, number):
    for name, df in run_check(number, empty, NOW).items():
        assert df.columns and df.schema, name
        df._jdf.queryExecution().executedPlan()


def test_recovery_point_across_servers(spark, empty):
    db = lambda s, n, m: frame(spark, "dim_database", {"database_id": 5, "database_name": n, "state_desc": "ONLINE", "recovery_model": m}, server=s)
    log = lambda s, n, i, at: frame(spark, "fact_backup", {"backup_set_id": i, "database_name": n, "type": "L", "start_date": ts(at), "finish_date": ts(at)}, server=s)
    t = {**empty, "dim_database": db("s1", "a", "FULL").union(db("s2", "a", "FULL")).union(db("s2", "b", "SIMPLE")),
         "fact_backup": log("s1", "a", 1, "2024-03-01 11:00").union(log("s1", "a", 2, "2024-03-01 11:45")).union(log("s2", "a", 3, "2024-02-01 00:00")).union(log("s2", "a", 4, "2024-02-01 05:00"))}
    got = rows(run_check("13_03", t, NOW)["databases"], "sql_instance", "database_name", "max_gap", "flag_missed_window", "flag_exposed")
    assert got == [("s1", "a", 45, 0, 0), ("s2", "a", 300, 1, 1), ("s2", "b", None, 0, 0)]


def test_duplicate_indexes_stay_within_their_server(spark, empty):
    col = lambda s, i, n, o: frame(spark, "fact_index_column", {"database_name": "d", "object_id": 1, "index_id": i, "index_name": f"i{i}", "key_ordinal": o, "column_name": n,
                                                               "is_descending_key": False, "is_included_column": False}, server=s)
    t = {**empty, "fact_index_column": col("s1", 1, "a", 1).union(col("s1", 2, "a", 1)).union(col("s1", 2, "b", 2)).union(col("s2", 3, "a", 1))}
    assert rows(run_check("11_04", t, NOW)["links"], "sql_instance", "index_1", "index_2", "duplicate_type") == [("s1", 1, 2, "INDEX1_IS_PREFIX")]
    m = frame(spark, "fact_missing_index", {"database_name": "d", "object_id": 1, "table_name": "t", "equality_columns": "[A], [B]", "user_seeks": 10, "avg_total_user_cost": 2.0, "avg_user_impact": 50.0})
    wanted = run_check("11_02", {**t, "fact_missing_index": m}, NOW)["wanted"]
    assert rows(wanted, "score", "evidence") == [(Decimal("10.0000"), "i2 [EXACT_KEY_MATCH; prefix=2] | i1 [EXISTING_IS_PREFIX_OF_MISSING; prefix=1]")]


def test_alert_gaps_and_operators(spark, empty):
    a = frame(spark, "fact_alert", {"alert_id": 1, "enabled": 1, "severity": 20, "message_id": 0, "notify_mask": 5, "operator_id": 7}, {"alert_id": 2, "enabled": 0, "severity": 21, "message_id": 0, "notify_mask": 2})
    o = frame(spark, "dim_operator", {"operator_id": 7, "enabled": 0}, {"operator_id": 8, "enabled": 0})
    got = run_check("17_05", {**empty, "fact_alert": a}, NOW)
    assert [r[0] for r in rows(got["severities"].filter("row_kind <> 'ACTUAL'"), "severity")] == [19, 21, 22, 23, 24, 25]
    assert rows(got["methods"], "bit", "rows") == [("Email", 1), ("NetSend", 1), ("Pager", 1)]
    ops = run_check("17_04", {**empty, "fact_alert": a, "dim_operator": o}, NOW)["operators"]
    assert rows(ops, "operator_id", "flag_disabled_but_referenced") == [(7, 1), (8, 0)]


def test_packed_job_history(spark, empty):
    job = frame(spark, "dim_job", {"job_id": "j", "job_name": "n", "enabled": 1, "owner_name": "anna"})
    run = lambda i, step, day, status: {"instance_id": i, "job_id": "j", "step_id": step, "run_date": day, "run_time": 10203, "run_duration": 10203, "run_status": status, "message": "Processed 0 pages"}
    h = frame(spark, "fact_job_run", run(1, 0, 20240220, 1), run(2, 1, 20240220, 0), run(3, 0, 20240221, 0), run(4, 1, 20240221, 0))
    steps = frame(spark, "dim_job_step", {"job_id": "j", "step_id": 1, "subsystem": "CmdExec", "command": "sqlcmd -P x; BACKUP LOG y"})
    t = {**empty, "dim_job": job, "fact_job_run": h, "dim_job_step": steps}
    got = run_check("17_02", t, NOW)
    assert rows(got["jobs"], "total_runs", "mean_sec", "last_status", "flag_last_failed") == [(2, 3723, 0, 1)]
    assert rows(got["silent"], "instance_id") == [(2,)]
    assert rows(run_check("17_03", t, NOW)["secrets"], "pattern", "texts") == [("-P ", 1)]
    assert rows(run_check("22_02", t, NOW)["jobs"], "category", "failures", "failure_flag") == [("LOG_BACKUP", 2, "HAS_FAILURES")]
    assert rows(run_check("17_01", t, NOW)["jobs"], "steps", "flag_never_run", "flag_personal_owner") == [(1, 0, 1)]


def test_slow_data_and_log_files_are_flagged(spark, empty):
    io = lambda kind, ms: {"database_id": 5, "file_id": 1, "file_class": kind, "num_of_reads": 100, "num_of_writes": 100, "io_stall_read_ms": ms * 100, "io_stall_write_ms": 0}
    t = {**empty, "fact_file_io": frame(spark, "fact_file_io", io("ROWS", 500), io("ROWS", 20), io("LOG", 6), io("OTHER", 500))}
    got = rows(run_check("05_05", t, NOW)["files"], "file_class", "read_ms", "flag_slow_read", "flag_slow_write")
    assert got == [("LOG", 6, 1, 0), ("OTHER", 500, 0, 0), ("ROWS", 20, 0, 0), ("ROWS", 500, 1, 0)]


def test_top_lists_are_per_server(spark, empty):
    use = lambda s: [{"session_id": i, "user_alloc": i, "user_dealloc": 0, "internal_alloc": 0, "internal_dealloc": 0} for i in range(40, 40 + s)]
    spill = lambda s: [{"query_hash": str(i), "spills": i, "execution_count": 1, "worker_time": 1, "last_execution_time": ts("2024-03-01 11:00")} for i in range(s)]
    both = lambda table, make: frame(spark, table, *make(40), server="s1").union(frame(spark, table, *make(14), server="s2"))
    t = {**empty, "fact_session": both("fact_session", use), "fact_query_stats": both("fact_query_stats", spill)}
    count = lambda df: dict(rows(df.groupBy("sql_instance").count()))
    sessions = run_check("06_02", t, NOW)["sessions"]
    assert count(sessions) == {"s1": 20, "s2": 3} and sessions.filter("session_id <= 50").isEmpty()
    assert count(run_check("08_04", t, NOW)["spills"]) == {"s1": 20, "s2": 13}
    assert rows(run_check("08_03", t, NOW)["hours"], "sql_instance", "entries") == [("s1", 40), ("s2", 14)]


def test_alert_gaps_of_one_server_are_not_filled_by_another(spark, empty):
    alert = lambda s, v: frame(spark, "fact_alert", {"alert_id": v, "enabled": 1, "severity": v, "message_id": 0}, server=s)
    servers = frame(spark, "dim_instance", {}, server="s1").union(frame(spark, "dim_instance", {}, server="s2")).union(frame(spark, "dim_instance", {}, server="s3"))
    t = {**empty, "dim_instance": servers, "fact_alert": alert("s1", 19).union(alert("s2", 20))}
    gaps = rows(run_check("17_05", t, NOW)["severities"].filter("row_kind <> 'ACTUAL'"), "sql_instance", "severity")
    assert gaps == sorted([(s, v) for s, has in (("s1", 19), ("s2", 20), ("s3", None)) for v in range(19, 26) if v != has])


def test_deadlocks_per_server_and_odd_times(spark, empty):
    doc = "<r>" + "".join(f'<event name="d" timestamp="{t}"><victim id="v"/></event>' for t in ("2024-01-01T10:00:00.123Z", "2024-01-01T11:00:00Z", "soon")) + "</r>"
    t = {**empty, "fact_event_document": frame(spark, "fact_event_document", {"document": doc}, server="s1").union(frame(spark, "fact_event_document", {"document": doc}, server="s2"))}
    got = run_check("10_03", t, NOW)
    assert rows(got["events"].filter("sql_instance = 's1'"), "event_time") == [(None,), (ts("2024-01-01 10:00:00.123"),), (ts("2024-01-01 11:00:00"),)] or \
        {r.event_time for r in got["events"].filter("sql_instance = 's1'").collect()} == {None, ts("2024-01-01 10:00:00.123"), ts("2024-01-01 11:00:00")}
    day = dt.date(2024, 1, 1)
    assert set(rows(got["per_day"], "sql_instance", "day", "rows")) >= {("s1", day, 2), ("s2", day, 2)}


def test_queues_are_per_database(spark, empty):
    db = lambda n, q: {"group_name": "g", "replica": "r", "database_name": n, "is_local": False, "send_queue": q, "send_rate": 10, "redo_queue": q, "redo_rate": 10}
    t = {**empty, "fact_replica_db": frame(spark, "fact_replica_db", db("a", 100), db("b", 500))}
    assert {r.database_name for r in run_check("19_03", t, NOW)["send"].collect()} == {"a", "b"}
