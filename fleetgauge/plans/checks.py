"""Ready-made checks on the landing tables (see `sources.schemas`), by check number.

`run_check("13_02", tables, as_of)` gives the result sets of one check for all servers at
once. Pass the rows to be checked: for snapshots usually one `run_date`, for histories the
whole table (each check sets its own time window). Limits are those of the operators' defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import band, flag, like_any
from fleetgauge.functions.numbers import exact, int_div, percent, row_count
from fleetgauge.functions.times import before, boundary_diff, instant, unpack_datetime, unpack_duration
from fleetgauge.session import write_once
from fleetgauge.operators import aggregates, joins, overlap, ranking, reporting, rules, sets, windows
from fleetgauge.operators.skew import salted_join
from fleetgauge.plans import reports

S = ["sql_instance"]
D = ["sql_instance", "database_name"]
O = [*D, "object_id"]
Results = dict[str, DataFrame]
CHECKS: dict[str, tuple[str, Callable[[Mapping[str, DataFrame], str], Results]]] = {}


def check(number: str, title: str):
    def register(build):
        CHECKS[number] = (title, build)
        return build
    return register


def run_check(number: str, tables: Mapping[str, DataFrame], as_of: str) -> Results:
    return CHECKS[number][1](tables, as_of)


def _setting(t, names):
    return reporting.pivot_settings(t["dim_setting"], S, "name", "value_in_use", names)


# servers ---------------------------------------------------------------------------------


@check("01_01", "processor topology and uneven nodes")
def _(t, now):
    inst = t["dim_instance"]
    nodes = t["fact_scheduler"].groupBy(*S, "node_id").agg(row_count().alias("schedulers"))
    return {"flags": rules.apply_rules(inst, {"flag_softnuma": F.col("softnuma_configuration") > 0, "flag_virtual": F.col("virtual_machine_type") > 0}, S).counts,
            "nodes": windows.peer_deviation(nodes, S, "schedulers")}


@check("01_02", "scheduler pressure and worker use")
def _(t, now):
    s = t["fact_scheduler"].filter(F.col("status").isin("VISIBLE ONLINE", "VISIBLE OFFLINE") & (F.col("scheduler_id") < 255))
    cap = t["dim_instance"].select(*S, F.col("max_workers").alias("capacity"))
    return {"schedulers": windows.peer_deviation(s.withColumn("flag_pressure", flag(F.col("runnable_tasks") > 2)), S, "runnable_tasks", factor=2),
            "nodes": aggregates.count_by(s, [*S, "node_id"], {"active": F.col("active_workers"), "runnable": F.col("runnable_tasks")}, {"most_runnable": F.col("runnable_tasks")}),
            "workers": aggregates.utilisation(s, F.col("active_workers"), cap, S)}


@check("01_03", "parallelism settings, overrides and waits")
def _(t, now):
    dop, cost = "max degree of parallelism", "cost threshold for parallelism"
    conf = _setting(t, [dop, cost]).join(t["dim_instance"], S)
    per_node = int_div(F.col("cpu_count"), F.col("numa_node_count"))
    general = _setting(t, [dop]).select(*S, F.col(dop).alias("general"))
    local = t["dim_database_setting"].filter("name = 'MAXDOP'")
    return {"settings": rules.apply_rules(conf, {
                "flag_unlimited": (F.col(dop) == 0) & (F.col("cpu_count") > 8), "flag_default_cost": F.col(cost) == 5,
                "flag_above_node": (F.col("numa_node_count") > 1) & (F.col(dop) > per_node)}, S).counts,
            "overrides": reporting.overrides(local, general, S, "value", "general"),
            "waits": windows.share(rules.exclude(t["fact_wait"], "wait_type", rules.IDLE_WAITS_PARALLELISM, []), "wait_ms", S).filter(
                F.col("wait_type").isin("CXPACKET", "CXCONSUMER", "EXCHANGE", "SOS_SCHEDULER_YIELD"))}


@check("01_04", "memory settings")
def _(t, now):
    low, high = "min server memory (MB)", "max server memory (MB)"
    conf = _setting(t, [low, high]).join(t["dim_instance"], S)
    return {"settings": rules.apply_rules(conf, {
                "flag_max_is_host": F.col(high) >= F.col("physical_memory_mb"), "flag_min_over_max": (F.col(low) > 0) & (F.col(low) >= F.col(high)),
                "flag_pressure": F.col("process_memory_low") == 1}, S).counts,
            "pending": rules.pending_change(t["dim_setting"].filter(F.col("name").isin(low, high)), "value", "value_in_use")}


@check("01_06", "memory clerks, nodes and grants")
def _(t, now):
    kind, name = F.col("clerk_type"), F.col("clerk_name")
    return {"clerks": rules.category_census(t["fact_memory_clerk"], rules.clerk_category(kind, name), "Other", S, {"pages_kb": F.sum("pages_kb")}),
            "nodes": windows.peer_deviation(t["fact_memory_node"], S, "pages_kb"),
            "grants": rules.grant_flags(t["fact_memory_grant"], "granted_kb", "used_kb", "grant_time")}


@check("03_01", "server identity and drift")
def _(t, now):
    drift = reporting.inventory_drift(t["dim_instance"], S, "collected_at", ["edition", "product_version", "product_level"])
    return {"latest": drift.latest, "changes": drift.changes, "outliers": drift.outliers}


@check("03_04", "settings waiting for a restart")
def _(t, now):
    return {"pending": rules.pending_change(t["dim_setting"], "value", "value_in_use")}


@check("04_02", "database options")
def _(t, now):
    db = t["dim_database"]
    return {"flags": rules.apply_rules(db, {"flag_trustworthy": F.col("is_trustworthy_on"), "flag_read_only": F.col("is_read_only")}, S).counts,
            "options": aggregates.count_by(db, [*S, "state_desc", "recovery_model", "compatibility_level"])}


@check("04_04", "owners, collation and log-backup block")
def _(t, now):
    db, names = t["dim_database"], t["dim_principal"]
    common = reporting.inventory_drift(db.withColumn("compat", F.col("compatibility_level").cast("string")), D, "collected_at", ["collation_name", "compat"])
    return {"owners": rules.owner_class(db, "owner_name", patterns=["NT AUTHORITY\\%", "NT SERVICE\\%", "BUILTIN\\%"]),
            "orphans": joins.orphans(db.withColumnRenamed("owner_sid", "sid"), names, [*S, "sid"]),
            "unlike_fleet": common.outliers,
            "blocked": db.filter((F.col("recovery_model") == "FULL") & (F.col("log_reuse_wait") == "LOG_BACKUP"))}


@check("04_05", "table sizes and odd names")
def _(t, now):
    i = F.col("index_id")
    sizes = aggregates.size_rollup(t["fact_table_size"], [*O, "table_name"], i, F.col("rows"), F.col("total_pages"), F.col("data_pages"))
    return {"largest": ranking.top_k_per(sizes, D, [F.desc("total_kb"), F.col("object_id")], 50),
            "odd_names": rules.suspicious_objects(sizes, "table_name", F.col("total_kb"), D)}


# storage and log -------------------------------------------------------------------------


@check("05_01", "volume space")
def _(t, now):
    return {"volumes": reports.volume_bands(t["fact_volume"], ["host", "volume"], F.col("size_bytes"), F.col("free_bytes"))}


@check("05_02", "file inventory")
def _(t, now):
    inv = reporting.file_inventory(t["dim_file"], "size", "max_size", "growth", F.col("is_percent_growth"), F.col("type") == 0, [*S, "database_id"])
    return {"files": inv.files, "totals": inv.totals}


@check("05_03", "growth events")
def _(t, now):
    e = t["fact_growth_event"]
    mb = int_div(F.col("integer_data"), F.lit(128))
    return {"events": rules.code_census(e.filter(F.col("event_class").isin(92, 93, 94, 95)), "event_class", rules.GROWTH_EVENT, D),
            "repeated": aggregates.repeated_small(e.filter(F.col("event_class").isin(92, 93)), [*D, "file_name", "event_class"], mb, "start_time")}


@check("05_05", "file latency")
def _(t, now):
    io = t["fact_file_io"].withColumns({
        "read_ms": int_div(F.col("io_stall_read_ms"), F.col("num_of_reads"), 0), "write_ms": int_div(F.col("io_stall_write_ms"), F.col("num_of_writes"), 0),
        "flag_idle": flag(F.col("num_of_reads") + F.col("num_of_writes") < 100)})
    rated = rules.class_threshold(io, "file_class", rules.LATENCY_LIMITS, F.col("read_ms"), "flag_slow_read")
    return {"files": rules.class_threshold(rated, "file_class", rules.LATENCY_LIMITS, F.col("write_ms"), "flag_slow_write")}


@check("05_08", "free space per database")
def _(t, now):
    return {"space": aggregates.free_space(t["fact_data_space"], t["fact_log_space"], D)}


@check("06_01", "temp files set up alike")
def _(t, now):
    f = t["dim_file"].filter((F.col("database_id") == 2) & (F.col("type") == 0))
    return {"files": aggregates.uniformity(f, S, "size", "growth")}


@check("06_02", "temp space by session")
def _(t, now):
    users = t["fact_session"].filter("session_id > 50")
    return {"sessions": ranking.net_top(users, [*S, "session_id"], ("user_alloc", "user_dealloc"), ("internal_alloc", "internal_dealloc"), by=S),
            "open": rules.age_flags(t["fact_session"].filter("transaction_begin_time is not null"), "transaction_begin_time", now, size="log_bytes_used")}


@check("06_03", "temp latency, contention and spills")
def _(t, now):
    io = t["fact_file_io"].filter("database_id = 2")
    return {"files": reporting.ratio_report(io, [*S, "file_id"], F.col("io_stall_read_ms"), F.col("num_of_reads"), zero=0),
            "classes": run_check("06_06", t, now)["classes"],
            "spills": ranking.top_k_per(t["fact_query_stats"].filter("spills > 0"), S, [F.desc("spills"), F.col("query_hash")], 20)}


@check("06_04", "old snapshots and large writers")
def _(t, now):
    open_work = t["fact_session"].filter("transaction_begin_time is not null and session_id > 50")
    return {"sessions": rules.age_flags(open_work, "transaction_begin_time", now, size="log_bytes_used"),
            "statements": reporting.statement_census(open_work, "batch_text", F.col("statement_start"), F.col("statement_end"), F.col("cpu_ms"), S)}


@check("06_05", "temp space by query")
def _(t, now):
    used = aggregates.weighted_stats(t["fact_query_runtime"], [*D, "query_id", "plan_id"], F.col("avg_tempdb_pages"), F.col("count_executions"), F.col("max_tempdb_pages"))
    return {"queries": ranking.top_k_per(used, D, [F.desc("estimated_total"), F.col("query_id"), F.col("plan_id")], 20)}


@check("06_06", "page contention")
def _(t, now):
    waits = t["fact_waiting_task"].filter(F.col("wait_type").startswith("PAGELATCH_") & F.col("resource").startswith("2:"))
    return {"classes": reporting.contention_census(waits, "resource", F.col("wait_ms"), S)}


@check("07_01", "log files beside data files")
def _(t, now):
    f = t["dim_file"].withColumn("drive", F.upper(F.regexp_extract("physical_name", r"^(.[^\\\\/]*)", 1)))
    return {"shared": joins.shares_location(f.filter("type = 1"), f.filter("type = 0"), [*S, "database_id"], ["drive"])}


@check("07_02", "log segments")
def _(t, now):
    # Advice per flag, and its order.
    advice = {"EXCESSIVE_VLF": "shrink and grow once in one large step", "MANY_SMALL_VLF": "set a fixed growth of 512 MB or more"}
    health = aggregates.segment_health(t["fact_log_segment"], D, F.col("vlf_size_mb"), F.col("vlf_active"))
    return {"segments": ranking.severity_sort(health, "segment_flag", {"EXCESSIVE_VLF": 1, "MANY_SMALL_VLF": 2}, [F.desc("segments")], 3),
            "census": rules.code_census(health, "segment_flag", {}, S, advice=advice)}


@check("07_03", "log reuse and log-backup age")
def _(t, now):
    db = t["dim_database"].filter("state_desc = 'ONLINE'")
    logs = joins.coverage(db.filter(F.col("recovery_model").isin("FULL", "BULK_LOGGED")).select(*D, "recovery_model"), t["fact_backup"].filter("type = 'L'"), D, {"last_log": F.max("finish_date")})
    return {"waits": ranking.severity_sort(db, "log_reuse_wait", ranking.LOG_REUSE_RANK, [F.col("database_name")]),
            "log_backups": logs.withColumn("status", band(rules.log_backup_ladder(F.col("last_log"), now), "OK")),
            "transactions": rules.age_flags(t["fact_session"].filter("transaction_begin_time is not null"), "transaction_begin_time", now)}


@check("07_04", "log-backup gaps")
def _(t, now):
    logs = t["fact_backup"].filter((F.col("type") == "L") & (F.col("finish_date") >= before(now, days=30)))
    gapped = windows.gaps(logs, D, "finish_date", start="start_date", tie=["backup_set_id"])
    stats = windows.gap_stats(gapped, D, "finish_date", count_first=True)
    return {"databases": windows.exposure(t["dim_database"], stats, D, now, "recovery_model", ("FULL", "BULK_LOGGED")),
            "gaps": windows.gap_list(gapped, D, "finish_date")}


# performance -----------------------------------------------------------------------------


@check("08_01", "waits")
def _(t, now):
    w = t["fact_wait"]
    return {"total": aggregates.total_row(w, F.col("tasks"), F.col("wait_ms"), F.col("signal_ms"), F.col("max_wait_ms"), by=S),
            "waits": reports.wait_profile(w, "wait_type", "tasks", "wait_ms", "signal_ms", "max_wait_ms", by=S),
            "deltas": windows.counter_delta(w, [*S, "wait_type"], "collected_at", {"wait_delta": "wait_ms", "tasks_delta": "tasks"}, "started_at")}


@check("08_02", "counters and processor samples")
def _(t, now):
    return {"counters": aggregates.count_by(t["fact_counter"], [*S, "object_name", "counter_name", "instance_name"], {"value": F.col("value")}),
            "blocked": aggregates.window_counts(t["fact_session"], {"blocked": (F.col("blocking_session_id") > 0, True)}, S)}


@check("08_03", "work per hour")
def _(t, now):
    return {"hours": aggregates.hourly(t["fact_query_stats"], "last_execution_time", now, F.col("worker_time"), F.col("execution_count"), by=S)}


@check("08_04", "plan cache and spills")
def _(t, now):
    mix = aggregates.cache_mix(t["fact_cached_plan"], "plan_type", F.col("use_count"), F.col("size_bytes"), by=S)
    return {"totals": mix.totals, "types": mix.by_type, "grants": rules.grant_flags(t["fact_memory_grant"], "granted_kb", "used_kb", "grant_time"),
            "spills": ranking.top_k_per(t["fact_query_stats"].filter("spills > 0"), S, [F.desc("spills"), F.col("query_hash")], 20)}


@check("09_01", "query waits by category")
def _(t, now):
    w = t["fact_query_wait"].withColumn("category", F.concat_ws("/", *D, "wait_category"))
    return {"categories": aggregates.category_impact(w, "category", F.col("total_wait_ms"), "plan_id", "query_id")}


@check("09_02", "costliest queries per database")
def _(t, now):
    r = t["fact_query_runtime"].filter(F.col("last_execution_time") >= before(now, days=7)).withColumn("total_ms", exact(F.col("avg_duration") * F.col("count_executions") / 1000))
    return {"queries": ranking.top_k_per(r, D, [F.desc("total_ms"), F.col("query_id"), F.col("plan_id"), F.desc("last_execution_time")], 50)}


@check("09_03", "plan spread and regressions")
def _(t, now):
    r = t["fact_query_runtime"].withColumn("ms", exact(F.col("avg_duration") / 1000, 4))
    recent = r.filter(F.col("last_execution_time") >= before(now, days=30))
    return {"spread": aggregates.variant_spread(r, [*D, "query_id"], "plan_id", F.col("ms"), "last_execution_time", now, 30),
            "forced": t["fact_query_plan"].filter("is_forced_plan").withColumn("flag_force_failed", flag(F.col("force_failure_count") > 0)).drop("query_plan"),
            "regressions": windows.regressions(recent, [*D, "query_id"], [F.desc("last_execution_time"), F.desc("plan_id")], "ms", 2, ["plan_id"])}


@check("09_04", "plan warnings")
def _(t, now):
    ran = t["fact_query_runtime"].filter(F.col("last_execution_time") >= before(now, days=30))
    plans = joins.has_match(t["fact_query_plan"], ran, [*D, "plan_id"])
    hits = rules.marker_flags(plans, "query_plan")
    return {"plans": hits.drop("query_plan"), "summary": rules.marker_summary(hits, D, list(rules.PLAN_MARKERS))}


@check("10_01", "blocking")
def _(t, now):
    b = joins.blocking(t["fact_session"], "session_id", "blocking_session_id", "wait_ms", ["login_name"], S)
    running = t["fact_session"].filter("blocking_session_id > 0")
    return {"pairs": b.pairs, "summary": b.summary,
            "statements": reporting.statement_census(running, "batch_text", F.col("statement_start"), F.col("statement_end"), F.col("cpu_ms"), S)}


@check("10_02", "lock waits and locks")
def _(t, now):
    l = t["fact_lock"]
    return {"waits": windows.share(t["fact_wait"].filter(like_any(F.col("wait_type"), ["LCK_%"]) & (F.col("wait_ms") > 0)), "wait_ms", S),
            "locks": aggregates.status_counts(l, [*D, "resource_type", "request_mode"], "request_status", {"granted": "GRANT", "waiting": "WAIT", "converting": "CONVERT"}, "waiting")}


@check("10_03", "deadlocks per day")
def _(t, now):
    events = reporting.xml_events(t["fact_event_document"], "document", S)
    return {"events": events, "per_day": aggregates.with_total(events.withColumn("day", F.to_date("event_time")), ["day"], by=S)}


# indexes and statistics ------------------------------------------------------------------


@check("11_01", "fragmentation")
def _(t, now):
    return {"indexes": rules.frag_flags(t["fact_index_stats"].filter("index_id > 0"), "frag_pct", "page_count", "fill_factor")}


def _signatures(t):
    c = t["fact_index_column"]
    return overlap.signature(c, [*O, "index_id"], ["key_ordinal"], "column_name", F.col("is_descending_key"), F.col("is_included_column"), ["index_name", "filter_definition"])


@check("11_02", "wanted indexes beside existing ones")
def _(t, now):
    m = t["fact_missing_index"]
    wanted = overlap.benefit(m, "table_name", "equality_columns", "inequality_columns", "included_columns", F.col("user_seeks"), F.col("avg_total_user_cost"), F.col("avg_user_impact"))
    wanted = wanted.withColumn("keys", overlap.normalised_keys(F.concat_ws(",", "equality_columns", "inequality_columns")))
    bare = overlap.signature(t["fact_index_column"], [*O, "index_id"], ["key_ordinal"], "column_name", None, F.col("is_included_column"), ["index_name", "type_desc", "is_unique", "is_primary_key"])
    have = bare.withColumns({
        "keys": F.transform("key_columns", lambda x: F.lower(x)),
        "details": F.concat(F.col("type_desc"), F.when(F.col("is_unique"), ", UQ").otherwise(""), F.when(F.col("is_primary_key"), ", PK").otherwise("")),
        "columns": F.concat(F.lit(" ("), F.array_join("key_columns", ", "), F.lit(")"), F.when(F.size("include_columns") > 0, F.concat(F.lit(" INCLUDE ("), F.array_join("include_columns", ", "), F.lit(")"))).otherwise(""))})
    matches = overlap.matching_indexes(wanted, have, O, carry=["details", "columns"])
    described = overlap.evidence_text(wanted, matches, O, details=F.col("details"), tail=F.col("columns")).withColumnRenamed("evidence", "existing_indexes")
    return {"matches": matches, "wanted": overlap.evidence_text(described, matches, O, details=F.col("details"))}


@check("11_03", "index use")
def _(t, now):
    objects = t["fact_index_stats"].filter("index_id > 0").select(*O, "index_id", "page_count").distinct()
    return {"indexes": overlap.usage_class(objects, t["fact_index_usage"], [*O, "index_id"])}


@check("11_04", "duplicate indexes")
def _(t, now):
    signatures = write_once(_signatures(t), "signatures")
    families = write_once(overlap.duplicate_families(signatures, O, "index_id", "filter_definition"), "families")
    return {"links": overlap.duplicate_pairs(signatures, O, "index_id", "filter_definition"), "indexes": families, "pairs": overlap.family_pairs(families, O, "index_id")}


@check("11_05", "index conditions")
def _(t, now):
    p = t["fact_index_place"]
    i = F.col("index_id")
    return {"misaligned": joins.misaligned(p, O, i > 1, i.isin(0, 1), "data_space_id"),
            "no_clustered": joins.unsupported_keys(p.filter("index_id > 1").select(*O).distinct(), p.filter("index_id = 1"), O)}


@check("11_06", "row groups")
def _(t, now):
    return {"groups": rules.rowgroup_flags(t["fact_row_group"], "total_rows", "deleted_rows", "state")}


@check("11_07", "foreign keys without an index")
def _(t, now):
    lead = t["fact_index_column"].filter((F.col("key_ordinal") == 1) & ~F.col("is_included_column")).withColumnRenamed("column_name", "leading_column")
    return {"keys": joins.unsupported_keys(t["fact_foreign_key"], lead, [*O, "leading_column"])}


@check("12_01", "statistics and their leading column")
def _(t, now):
    c = t["fact_stats_column"]
    lead = windows.latest(c, [*O, "stats_id"], [F.col("ordinal"), F.col("column_name")]).select(*O, "stats_id", F.col("column_name").alias("leading_column"))
    counted = joins.counts_per(t["fact_stats"], c, [*O, "stats_id"], {"columns": None})
    return {"statistics": counted.join(lead, [*O, "stats_id"], "left")}


@check("12_02", "statistics freshness")
def _(t, now):
    return {"statistics": rules.freshness(t["fact_stats"], "last_updated", "rows", "rows_sampled", "modifications", now)}


@check("12_03", "overlapping statistics")
def _(t, now):
    sig = overlap.signature(t["fact_stats_column"], [*O, "stats_id"], ["ordinal"], "column_name", keep=["filter_definition"])
    return {"links": overlap.overlapping_stats(sig, O, "stats_id", "filter_definition")}


# backups and integrity -------------------------------------------------------------------


def _sec():
    return boundary_diff("second", F.col("start_date"), F.col("finish_date"))


def _mb():
    return F.col("backup_size") / 1048576


@check("13_01", "backup coverage")
def _(t, now):
    db = t["dim_database"].filter("state_desc = 'ONLINE' and database_id > 4").select(*D, "recovery_model")
    return {"databases": reports.backup_coverage(db, t["fact_backup"], D, "type", "finish_date", "recovery_model", now, {"device_name": "device"}, "backup_size")}


def _recoverability(t, now):
    db = t["dim_database"].filter("state_desc = 'ONLINE' and database_id > 4").select(*D, "recovery_model")
    return reports.recoverability(db, t["fact_backup"], D, "type", "start_date", "finish_date", "first_lsn", "last_lsn", "differential_base_lsn", "recovery_model",
                                  F.col("is_copy_only"), _mb(), _sec(), "recovery_model", now, ["backup_set_id"])


@check("13_02", "backup chain")
def _(t, now):
    return {"anomalies": _recoverability(t, now).chain}


@check("13_03", "recovery point")
def _(t, now):
    return {"databases": _recoverability(t, now).exposure}


@check("13_04", "restore time")
def _(t, now):
    files = t["dim_file"].join(t["dim_database"].select("sql_instance", "database_id", "database_name"), [*S, "database_id"])
    return {"databases": reports.rto_indicators(t["dim_database"].select(*D, "recovery_model"), files.filter("type = 0"), t["fact_backup"], t["fact_log_segment"], D,
                                                int_div(F.col("size"), F.lit(128)), "type", "start_date", "finish_date", F.col("backup_size"), now)}


@check("13_05", "backup retention, places, throughput")
def _(t, now):
    r = _recoverability(t, now)
    recent = t["fact_backup"].filter(F.col("finish_date") >= before(now, days=90))
    return {"retention": r.retention, "throughput": r.throughput, "places": reporting.location_census(recent, [*D, "type"], "device_name")}


@check("14_01", "integrity checks")
def _(t, now):
    db = t["dim_database"].filter("state_desc = 'ONLINE' and database_id > 4").select(*D, "recovery_model")
    return {"databases": reports.check_history(db, t["fact_log_line"], ["database_name"], "database_name", "log_date", "text", now, ["line_id"], by=S)}


@check("14_02", "I/O and corruption lines")
def _(t, now):
    return {"lines": reports.log_errors(t["fact_log_line"], "log_date", "text", now, [*S, "process_info"])}


@check("14_03", "damaged pages")
def _(t, now):
    return {"pages": reports.damage_report(t["fact_suspect_page"], "event_type", "error_count", "last_update_date", now)}


@check("14_04", "automatic page repair")
def _(t, now):
    p = t["fact_page_repair"].withColumns({"days_ago": boundary_diff("day", F.col("modification_time"), instant(now)),
                                           "repair_flag": F.when(F.col("page_status").isin(5, 6), "REPAIR_FAILED").otherwise("")})
    return {"pages": windows.recurrence(p, [*D, "file_id", "page_id"]), "states": rules.code_census(p, "page_status", rules.REPAIR_STATUS, D, None)}


# security and encryption -----------------------------------------------------------------


@check("15_01", "logins")
def _(t, now):
    return {"logins": rules.owner_class(t["dim_principal"].filter(~F.col("name").startswith("##")), "name")}


@check("15_02", "roles and permissions")
def _(t, now):
    p = reports.privileges(t["dim_principal"], t["fact_role_member"], t["fact_permission"], S)
    return {"members": p.members, "permissions": p.permissions, "builtin": p.builtin}


@check("15_03", "database users")
def _(t, now):
    u = t["fact_database_user"]
    return {"roles": reporting.memberships(u, [*D, "user_name"], "role_name", "db_owner", "flag_db_owner"),
            "orphans": joins.orphans(u.select(*D, "user_name", "sid").distinct(), t["dim_principal"], [*S, "sid"])}


@check("15_04", "trust between databases")
def _(t, now):
    db = t["dim_database"].filter("database_id > 4")
    return {"flags": rules.apply_rules(db, {"flag_trustworthy": F.col("is_trustworthy_on")}, S).flagged}


@check("15_05", "built-in accounts and administrators")
def _(t, now):
    p = reports.privileges(t["dim_principal"], t["fact_role_member"], t["fact_permission"], S)
    return {"builtin": p.builtin, "administrators": p.members.filter("role_name = 'sysadmin'")}


@check("15_07", "password policy")
def _(t, now):
    return {"logins": reports.login_policy(t["dim_principal"].filter("type = 'S' and not name like '##%##'"), "password_hash", "password_last_set", "is_policy_checked", "is_expiration_checked", "is_disabled", now)}


@check("16_01", "connections by encryption")
def _(t, now):
    return {"connections": aggregates.count_by(t["fact_connection"], [*S, "net_transport", "encrypt_option"])}


@check("16_02", "database encryption")
def _(t, now):
    e = t["fact_encryption"].withColumn("expiry_flag", band(rules.expiry_ladder(F.col("expiry_date"), now), "OK"))
    return {"databases": e, "states": rules.code_census(e, "encryption_state", rules.ENCRYPTION_STATE, S, None),
            "progress": reporting.progress(e.filter(F.col("encryption_state").isin(2, 4, 5, 6)), D, F.col("done"), F.col("total"))}


@check("16_04", "certificates")
def _(t, now):
    return {"expiry": reports.expiry_report({"all": t["dim_certificate"]}, "expiry_date", now, [*S, "source"])}


# jobs ------------------------------------------------------------------------------------


def _runs(t):
    return t["fact_job_run"].withColumns({"run_at": unpack_datetime(F.col("run_date"), F.col("run_time")), "seconds": unpack_duration(F.col("run_duration"))})


J = ["sql_instance", "job_id"]


@check("17_01", "job inventory")
def _(t, now):
    runs = _runs(t).filter("step_id = 0")
    jobs = rules.owner_class(t["dim_job"], "owner_name")
    return {"jobs": reports.job_inventory(jobs, t["dim_job_step"], t["dim_schedule"], runs, J, "enabled", F.col("schedule_enabled") == 1, "next_run", "run_at", "run_status", ["instance_id"])}


@check("17_02", "job reliability")
def _(t, now):
    runs = _runs(t)
    recent = runs.filter(F.col("run_at") >= before(now, days=90))
    return {"jobs": reports.job_reliability(t["dim_job"], runs.filter("step_id = 0"), J, "run_at", "run_status", F.col("seconds"), now),
            "silent": reports.silent_failures(recent.filter("step_id > 0"), recent.filter("step_id = 0"), J, "run_date", F.col("run_status") == 0, F.col("run_status") == 1)}


@check("17_03", "job owners, risky steps, secrets")
def _(t, now):
    risky = F.col("subsystem").isin("CmdExec", "PowerShell", "ActiveScripting", "SSIS")
    return {"owners": rules.owner_class(t["dim_job"], "owner_name"), "risky": rules.apply_rules(t["dim_job_step"], {"flag_risky": risky}, J).counts,
            "secrets": rules.scan_secrets(t["dim_job_step"], "command", J)}


@check("17_04", "operators referenced but disabled")
def _(t, now):
    both = lambda df, c: df.filter(F.col(c) > 0).select(F.struct("sql_instance", F.col(c).alias("operator_id")).alias("r"))
    used = sets.distinct_refs([(both(t["fact_alert"], "operator_id"), "r"), (both(t["dim_job"], "notify_operator_id"), "r")]).select("ref.*")
    got = joins.coverage(t["dim_operator"], used, [*S, "operator_id"], {}).withColumnRenamed("flag_missing", "flag_unreferenced")
    return {"operators": got.withColumn("flag_disabled_but_referenced", flag((F.col("enabled") == 0) & (F.col("matches") > 0)))}


@check("17_05", "alerts and gaps")
def _(t, now):
    a = t["fact_alert"]
    # Severities and messages that need an alert.
    return {"severities": joins.coverage_gap(a, list(range(19, 26)), "severity", (F.col("enabled") == 1) & (F.col("message_id") == 0), by=S, groups=t["dim_instance"]),
            "messages": joins.coverage_gap(a, [823, 824, 825, 9002], "message_id", F.col("enabled") == 1, by=S, groups=t["dim_instance"]),
            "methods": rules.bit_census(a, "notify_mask", rules.NOTIFY_BITS, S)}


@check("17_06", "mail queue")
def _(t, now):
    state, at = F.col("item_state"), F.col("item_date")
    return {"queue": aggregates.window_counts(t["fact_mail"], {
        "FailedItems_Last7Days": ((state == "failed") & (at >= before(now, days=7)), True), "UnsentItems_Current": (state == "unsent", True),
        "SentItems_Last24Hours": ((state == "sent") & (at >= before(now, hours=24)), False)}, S)}


@check("18_01", "host events")
def _(t, now):
    return {"events": reports.host_events(t["fact_host_event"], "time_created", "provider", "level", "message", now)}


# replicas --------------------------------------------------------------------------------

R = ["sql_instance", "group_name", "replica"]


@check("19_01", "replica state")
def _(t, now):
    return {"replicas": rules.replica_flags(t["fact_replica"], "connected_state", "sync_health", "availability_mode", "operational_state", "role", "last_error_time", now)}


@check("19_02", "database synchronisation")
def _(t, now):
    state = F.when(~F.col("sync_state").isin("SYNCHRONIZED", "SYNCHRONIZING"), "NOT_SYNCHRONIZING").otherwise("")
    return {"databases": t["fact_replica_db"].withColumn("database_flag", state)}


@check("19_07", "automatic page repair on replicas")
def _(t, now):
    return run_check("14_04", t, now)


@check("19_09", "lease health")
def _(t, now):
    flagged = run_check("19_01", t, now)["replicas"]
    recent = F.col("last_error_time") >= before(now, hours=24)
    return {"replicas": flagged, "errors": aggregates.window_counts(t["fact_replica"], {"RecentErrors_Last24Hours": (recent, True)}, [*S, "group_name"])}


@check("19_03", "send and redo queues")
def _(t, now):
    r, per = t["fact_replica_db"].filter(~F.col("is_local")), [*R, "database_name"]
    return {"send": reporting.catch_up(r, per, F.col("send_queue"), F.col("send_rate"), whole=True), "redo": reporting.catch_up(r, per, F.col("redo_queue"), F.col("redo_rate"), whole=True)}


@check("19_05", "backup preference")
def _(t, now):
    # Preference codes.
    labels = {0: "any replica", 1: "secondary preferred", 2: "secondary only", 3: "primary only"}
    return {"preference": rules.code_census(t["fact_replica"], "backup_preference", labels, [*S, "group_name", "role"], None)}


@check("19_06", "replica error lines")
def _(t, now):
    # Search words.
    words = ["AlwaysOn", "availability replica", "endpoint", "lease", "seeding"]
    return {"lines": reports.log_errors(t["fact_log_line"], "log_date", "text", now, [*S, "process_info"], [(w, w, "INVESTIGATE") for w in words])}


@check("19_08", "read-only routing")
def _(t, now):
    return {"routes": reporting.route_list(t["fact_routing"], R, ["priority"], "target")}


@check("19_10", "data loss and failover readiness")
def _(t, now):
    dbs = t["fact_replica_db"]
    sync = t["fact_replica"].filter("availability_mode = 'SYNCHRONOUS_COMMIT' and role = 'SECONDARY'")
    lagging = salted_join(dbs.filter(~F.col("is_local")), t["fact_replica"].filter("availability_mode = 'ASYNCHRONOUS_COMMIT'").select(*R).distinct(), R, "left_semi")
    ready = joins.counts_per(sync, dbs, R, {"databases": None, "synchronized": F.col("sync_state") == "SYNCHRONIZED"})
    return {"exposure": reporting.catch_up(lagging, [*R, "database_name"], F.col("redo_queue"), F.col("redo_rate"), 524_288, 102_400),
            "readiness": rules.readiness(ready, "failover_mode", "connected_state", "sync_health")}


@check("19_11", "log held up by a replica")
def _(t, now):
    held = t["dim_database"].filter("log_reuse_wait = 'AVAILABILITY_REPLICA'").select(*D).distinct()
    r = salted_join(t["fact_replica_db"].filter(~F.col("is_local")), held, D, "left_semi")
    return {"replicas": reporting.catch_up(r, [*R, "database_name"], F.col("send_queue"), F.col("send_rate"), 1_048_576, 102_400)}


@check("19_12", "seeding progress")
def _(t, now):
    return {"progress": reporting.progress(t["fact_seeding"], D, F.col("transferred_bytes"), F.col("database_bytes"))}


@check("19_15", "versions across replicas")
def _(t, now):
    return {"outliers": reporting.inventory_drift(t["dim_instance"], S, "collected_at", ["product_version", "product_level"]).outliers}


@check("21_01", "connection errors")
def _(t, now):
    # Search words.
    lines = reports.log_errors(t["fact_log_line"], "log_date", "text", now, [*S, "process_info"], [(w, w, "INVESTIGATE") for w in ("connection", "timeout", "transport")])
    return {"lines": ranking.top_k_per(lines, S, [F.desc("log_date"), F.col("process_info"), F.col("text")], 200)}


@check("22_01", "maintenance steps")
def _(t, now):
    s = t["dim_job_step"].filter(like_any(F.col("command"), rules.MAINTENANCE_SCOPE, True))
    return {"steps": rules.category_census(s, rules.maintenance_category(F.col("command")), by=J)}


@check("22_02", "maintenance effect")
def _(t, now):
    runs = _runs(t).filter(F.col("run_at") >= before(now, days=90)).join(t["dim_job_step"].select(*J, "step_id", "command"), [*J, "step_id"])
    return {"jobs": reports.maintenance_effect(runs, J, "command", "run_date", "run_status", "message", 1)}


@check("22_03", "owners")
def _(t, now):
    return {"jobs": rules.owner_class(t["dim_job"], "owner_name"), "databases": rules.owner_class(t["dim_database"], "owner_name"),
            "certificates": rules.band_census(t["dim_certificate"], [(F.col("expiry_date") < instant(now), "EXPIRED"),
                                                                     (boundary_diff("day", instant(now), F.col("expiry_date")) < 90, "EXPIRING_SOON")], "INFO", S)}
