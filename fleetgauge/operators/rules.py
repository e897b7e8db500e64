"""Rule jobs: filter and flag a snapshot or history in one pass, then count per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import Ladder, any_of, band, flag, label_of, like_any
from fleetgauge.functions.numbers import row_count, whole_ratio
from fleetgauge.functions.times import before, boundary_diff, instant


class RuleResult(NamedTuple):
    flagged: DataFrame
    counts: DataFrame


def apply_rules(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str]) -> RuleResult:
    """Rows with any flag set, and flag counts per group. A NULL condition gives 0."""
    marked = df.withColumns({name: flag(cond) for name, cond in rules.items()})
    flagged = marked.filter(any_of([F.col(n) == 1 for n in rules]))
    counts = marked.groupBy(*by).agg(row_count().alias("rows"), *[F.sum(n).alias(n) for n in rules])
    return RuleResult(flagged, counts)


def band_census(df: DataFrame, ladder: Ladder, default: str, by: Sequence[str] = (),
                out: str = "band") -> DataFrame:
    """Rows per label of a first-match ladder."""
    return df.groupBy(*by, band(ladder, default).alias(out)).agg(row_count().alias("rows"))


# Free-space, segment-count, certificate and log-backup ladders.
def free_space_ladder(free_pct: Column) -> Ladder:
    return [(free_pct < 0, "ERROR"), (free_pct < 10, "LOW_FREE_SPACE"), (free_pct < 20, "WATCH")]


def segment_ladder(count: Column) -> Ladder:
    return [(count < 0, "CollectionError"), (count < 100, "OK"), (count < 500, "Moderate"),
            (count < 1000, "High")]


def expiry_ladder(expiry: Column, as_of) -> Ladder:
    days = boundary_diff("day", instant(as_of), expiry)
    return [(expiry.isNull(), "N/A"), (expiry < instant(as_of), "EXPIRED"), (days < 30, "CRITICAL"),
            (days < 90, "HIGH"), (days < 180, "WARNING")]


def log_backup_ladder(last: Column, as_of) -> Ladder:
    return [(last.isNull(), "NEVER_BACKED_UP"), (last < before(as_of, hours=24), "NO_BACKUP_LAST_24H"),
            (last < before(as_of, hours=1), "NO_BACKUP_LAST_1H")]


def class_threshold(df: DataFrame, cls: str, limits: Mapping[str, float], metric: Column,
                    out: str = "flag_over_limit") -> DataFrame:
    """A limit per row class; classes without a limit are never flagged."""
    limit = label_of(F.col(cls), limits, unknown=None)
    return df.withColumns({"class_limit": limit, out: flag(metric > limit)})


# Data files may take 20 ms, log files 5 ms.
LATENCY_LIMITS = {"ROWS": 20, "LOG": 5}


def code_census(df: DataFrame, code: str, labels: Mapping, by: Sequence[str] = (),
                unknown: str | None = "text", advice: Mapping | None = None) -> DataFrame:
    """Rows per code with its label (and advice); labels are added after the count."""
    counted = df.groupBy(*by, code).agg(row_count().alias("rows"))
    counted = counted.withColumn("label", label_of(F.col(code), labels, unknown))
    if advice is not None:
        counted = counted.withColumn("advice", label_of(F.col(code), advice, ""))
    return counted


# Code maps.
RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Cancelled", 4: "In Progress"}
BACKUP_TYPE = {"D": "Full", "I": "Differential", "L": "Log", "F": "File/Filegroup",
               "G": "Differential File", "P": "Partial", "Q": "Differential Partial"}
TRANSACTION_TYPE = {1: "Read/Write", 2: "Read-Only", 3: "System", 4: "Distributed"}
TRANSACTION_STATE = {0: "Uninitialized", 1: "Not Started", 2: "Active", 3: "Ended",
                     4: "Commit Initiated", 5: "Prepared", 6: "Committed", 7: "Rolling Back",
                     8: "Rolled Back"}
PAGE_EVENT = {1: "823 or 824 error (hard IO error or bad checksum)", 2: "Bad checksum",
              3: "Torn page", 4: "Restored", 5: "Repaired (DBCC)", 7: "Deallocated by DBCC"}
REPAIR_STATUS = {2: "Queued for repair", 3: "Repair in progress", 4: "Repair succeeded",
                 5: "Repair failed", 6: "Not repairable"}
ENCRYPTION_STATE = {0: "No encryption", 1: "Unencrypted", 2: "Encryption in progress",
                    3: "Encrypted", 4: "Key change in progress", 5: "Decryption in progress",
                    6: "Protection change in progress"}
GROWTH_EVENT = {92: "Data File Auto Grow", 93: "Log File Auto Grow",
                94: "Data File Auto Shrink", 95: "Log File Auto Shrink"}


def category_census(df: DataFrame, rules: Ladder, default: str = "OTHER", by: Sequence[str] = (),
                    measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows (and measures) per category of an ordered rule list."""
    aggs = [c.alias(n) for n, c in (measures or {}).items()]
    return df.groupBy(*by, band(rules, default).alias("category")).agg(row_count().alias("rows"), *aggs)


# Wait names that say nothing about load, and the patterns beside them.
IDLE_WAITS = [
    "SLEEP_TASK", "LAZYWRITER_SLEEP", "SQLTRACE_BUFFER_FLUSH", "CLR_AUTO_EVENT",
    "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE", "SERVER_IDLE_CHECK", "SLEEP_DBSTARTUP",
    "SLEEP_DBRECOVER", "SLEEP_DBTASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT",
    "DISPATCHER_QUEUE_SEMAPHORE", "BROKER_TO_FLUSH", "CHECKPOINT_QUEUE", "DBMIRROR_EVENTS_QUEUE",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "HADR_WORK_QUEUE",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_WORK_POOL_WAIT", "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT", "WAITFOR", "BROKER_EVENTHANDLER", "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "REDO_THREAD_PENDING_WORK",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "DIRTY_PAGE_POLL", "XIO_IDLE",
]
# The waits left out of the total that parallelism waits are compared with.
IDLE_WAITS_PARALLELISM = [
    "SLEEP_TASK", "BROKER_TO_FLUSH", "BROKER_TASK_STOP", "CLR_AUTO_EVENT", "DISPATCHER_QUEUE_SEMAPHORE",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_WORK_QUEUE", "LAZYWRITER_SLEEP",
    "LOGMGR_QUEUE", "ONDEMAND_TASK_QUEUE", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE", "SERVER_IDLE_CHECK",
    "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP", "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED",
    "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT", "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAITFOR",
    "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT", "BROKER_EVENTHANDLER", "CHECKPOINT_QUEUE", "DBMIRROR_EVENTS_QUEUE",
    "SQLTRACE_WAIT_ENTRIES", "WAIT_XTP_CKPT_CLOSE",
]
IDLE_WAIT_PATTERNS = ["SLEEP_%", "SQLTRACE_%", "DBMIRROR_%"]


def wait_category(wait: Column, total: Column, signal: Column) -> Ladder:
    """Wait categories, first match wins; a signal share above 70 % counts as CPU.

    THREADPOOL is caught by CPU, so WORKER_THREAD is never reached. The order is kept.
    """
    # Names and patterns per category.
    return [
        (wait.isin("SOS_SCHEDULER_YIELD", "THREADPOOL") | ((total > 0) & (signal * 10 > total * 7)), "CPU"),
        (like_any(wait, ["PAGEIOLATCH_%"]) | wait.isin("IO_COMPLETION", "ASYNC_IO_COMPLETION", "WRITE_COMPLETION"), "IO"),
        (like_any(wait, ["LCK_%"]), "LOCK"),
        (wait.isin("WRITELOG", "LOGBUFFER", "LOG_RATE_GOVERNOR"), "LOG"),
        (wait.isin("RESOURCE_SEMAPHORE", "RESOURCE_SEMAPHORE_QUERY_COMPILE", "CMEMTHREAD"), "MEMORY"),
        (wait.isin("ASYNC_NETWORK_IO", "NET_WAITFOR_PACKET"), "NETWORK"),
        (like_any(wait, ["BACKUP%"]), "BACKUP"),
        (like_any(wait, ["HADR_%"]) | (wait == "DBMIRRORING_CMD"), "AG"),
        (wait.isin("CXPACKET", "CXCONSUMER", "EXCHANGE"), "PARALLELISM"),
        (wait == "THREADPOOL", "WORKER_THREAD"),
    ]


def clerk_category(kind: Column, name: Column) -> Ladder:
    # Memory clerk groups.
    return [
        (kind == "MEMORYCLERK_SQLBUFFERPOOL", "Buffer Pool"),
        (like_any(kind, ["CACHESTORE%"]), "Plan/Object Cache"),
        (kind == "MEMORYCLERK_SQLCLR", "CLR"),
        ((name == "LOCK") | like_any(kind, ["%LOCK%"]), "Lock Manager"),
        (kind == "MEMORYCLERK_SQLTRACE", "SQL Trace"),
        (like_any(kind, ["%XTP%"]), "In-Memory OLTP"),
    ]


# Command patterns that make a job step a maintenance step.
MAINTENANCE_SCOPE = ["%BACKUP%", "%CHECKDB%", "%STATISTICS%", "%REBUILD%", "%REORGANIZE%",
                     "%sp_delete%history%", "%CleanupHistory%"]


def maintenance_category(command: Column) -> Ladder:
    # Command patterns per kind of maintenance.
    return [
        (like_any(command, ["%BACKUP DATABASE%"], True), "FULL_BACKUP"),
        (like_any(command, ["%BACKUP LOG%"], True), "LOG_BACKUP"),
        (like_any(command, ["%DBCC CHECKDB%", "%DBCC CHECKFILEGROUP%"], True), "INTEGRITY_CHECK"),
        (like_any(command, ["%UPDATE STATISTICS%"], True), "STATISTICS"),
        (like_any(command, ["%REBUILD%", "%REORGANIZE%"], True), "INDEX_MAINTENANCE"),
        (like_any(command, ["%DELETE%msdb%backupset%", "%sp_delete_backuphistory%"], True), "HISTORY_CLEANUP"),
    ]


def exclude(df: DataFrame, column: str, names: Sequence[str] = IDLE_WAITS,
            patterns: Sequence[str] = IDLE_WAIT_PATTERNS) -> DataFrame:
    """Rows whose key is neither listed nor matched. A NULL key is dropped, as NOT IN does.
    The underscore of a pattern is a wildcard."""
    key = F.col(column)
    listed = key.isin(*names) if names else F.lit(False)
    matched = like_any(key, patterns) if patterns else F.lit(False)
    return df.filter(key.isNotNull() & ~listed & ~matched)


def flag_combinations(df: DataFrame, labels: Ladder, by: Sequence[str] = (),
                      out: str = "flags") -> DataFrame:
    """Rows per combination of all true labels, in list order."""
    text = F.concat_ws(" ", *[F.when(cond, label) for cond, label in labels])
    return df.groupBy(*by, text.alias(out)).agg(row_count().alias("rows"))


def bit_census(df: DataFrame, mask: str, bits: Mapping[int, str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per set bit: one aggregate for all bits, then one row per bit that occurs."""
    counts = df.groupBy(*by).agg(*[
        F.sum(F.when(F.col(mask).bitwiseAND(F.lit(b)) > 0, 1).otherwise(0)).alias(f"_b{b}") for b in bits])
    pairs = F.array(*[F.struct(F.lit(label).alias("bit"), F.col(f"_b{b}").alias("rows"))
                      for b, label in bits.items()])
    return (counts.select(*by, F.explode(pairs).alias("p")).select(*by, "p.bit", "p.rows")
            .filter(F.col("rows") > 0))


# Notification methods.
NOTIFY_BITS = {1: "Email", 2: "Pager", 4: "NetSend"}


def pending_change(df: DataFrame, configured: str, running: str, null_safe: bool = False) -> DataFrame:
    """Rows whose configured value differs from the running one. NULLs count only if asked."""
    a, b = F.col(configured), F.col(running)
    return df.filter(~a.eqNullSafe(b) if null_safe else a != b)


def grant_flags(df: DataFrame, granted: str, used: str, grant_time: str) -> DataFrame:
    """Memory grants: still pending, more than twice what was used, less than half used."""
    g, u, issued = F.col(granted), F.col(used), F.col(grant_time).isNotNull()
    return df.withColumns({
        "flag_pending": flag(~issued),
        "flag_excessive": flag(issued & (u > 0) & (g > u * 2)),
        "flag_underused": flag(issued & (g > 0) & (u * 2 < g)),
    })


def frag_flags(df: DataFrame, pct: str, pages: str, fill: str, min_pages: int = 100,
               big: int = 1000, fills: Sequence[int] = (0, 80, 85, 90)) -> DataFrame:
    """Fragmentation level of objects above a size floor, and unusual fill factors."""
    p, n = F.col(pct), F.col(pages)
    level = band([((p > 30) & (n > big), "HIGH"), ((p > 10) & (n > big), "MEDIUM")], "OK")
    return df.filter(n > min_pages).withColumns({
        "fragmentation": level,
        "fill_factor_flag": F.when(~F.col(fill).isin(*fills), "NONSTANDARD_FILLFACTOR").otherwise("OK"),
    })


def rowgroup_flags(df: DataFrame, total: str, deleted: str, state: str, full: int = 102_400) -> DataFrame:
    """Row groups with many deleted rows, closed too small, or still open."""
    return df.withColumns({
        "deleted_flag": F.when((F.col(total) > 0) & (F.col(deleted) * 5 > F.col(total)), "HIGH_DELETED_ROWS").otherwise(""),
        "undersized_flag": F.when((F.col(total) < full) & (F.col(state) == "COMPRESSED"), "UNDERSIZED_ROWGROUP").otherwise(""),
        "open_flag": F.when(F.col(state) == "OPEN", "TUPLE_MOVER_BACKLOG").otherwise(""),
    })


def freshness(df: DataFrame, updated: str, rows: str, sampled: str, mods: str, as_of) -> DataFrame:
    """Statistics age, sample share and their flags."""
    days = boundary_diff("day", F.col(updated), instant(as_of))
    m, n = F.col(mods), F.col(rows)
    ladder = [(F.col(updated).isNull(), "NEVER_UPDATED"), ((days > 30) & (m > 1000), "STALE_HIGH_MODS"),
              (m * 5 > n, "HIGH_MOD_RATE")]
    return df.withColumns({
        "days_since_update": days,
        "sample_pct": whole_ratio(F.col(sampled), n, 1, 100),
        "freshness": band(ladder, "OK"),
        "sample_flag": F.when((n > 0) & (F.col(sampled) * 10 < n), "LOW_SAMPLE").otherwise("OK"),
    })


# Owner names and patterns that are not a person.
SYSTEM_OWNERS = ["sa"]
SERVICE_OWNER_PATTERNS = ["NT AUTHORITY\\%", "NT SERVICE\\%", "%svc%", "%service%", "%agent%", "%sql%"]


def owner_class(df: DataFrame, owner: str, names: Sequence[str] = SYSTEM_OWNERS,
                patterns: Sequence[str] = SERVICE_OWNER_PATTERNS) -> DataFrame:
    """1 for an owner that looks like a person, and for an owner that no longer exists."""
    o = F.col(owner)
    known = F.lower(o).isin(*[n.lower() for n in names]) | like_any(o, patterns, ignore_case=True)
    return df.withColumn("flag_personal_owner", F.when(o.isNull(), 1).when(known, 0).otherwise(1))


# Name endings of left-over objects.
LEFTOVER_SUFFIXES = ["_bak", "_backup", "_copy", "_old", "_temp", "_staging"]


def suspicious_objects(df: DataFrame, name: str, size: Column, by: Sequence[str] = (),
                       suffixes: Sequence[str] = LEFTOVER_SUFFIXES) -> DataFrame:
    """Objects and size per suspicious name pattern."""
    lowered = F.lower(F.col(name))
    ladder = [(lowered.endswith(s), f"Suffix: {s}") for s in suffixes]
    ladder.append((F.col(name).rlike("[0-9]{4}$"), "Date-suffix pattern detected"))
    return (df.withColumn("pattern", band(ladder, None)).filter(F.col("pattern").isNotNull())
            .groupBy(*by, "pattern").agg(row_count().alias("objects"), F.sum(size).alias("total_size")))


# Texts that announce a credential.
SECRET_PATTERNS = ["password", "passwd", "-P ", "-P\"", "pwd=", "pwd ="]


def scan_secrets(df: DataFrame, text: str, by: Sequence[str] = (),
                 patterns: Sequence[str] = SECRET_PATTERNS) -> DataFrame:
    """Texts per pattern and owner, one pass over the text for all patterns."""
    lowered = F.lower(F.col(text))
    hits = df.groupBy(*by).agg(*[
        F.sum(F.when(lowered.contains(p.lower()), 1).otherwise(0)).alias(f"_p{i}")
        for i, p in enumerate(patterns)])
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"_p{i}").alias("texts"))
                      for i, p in enumerate(patterns)])
    return (hits.select(*by, F.explode(pairs).alias("p")).select(*by, "p.pattern", "p.texts")
            .filter(F.col("texts") > 0))


# Markers of a plan document.
PLAN_MARKERS = {
    "implicit_conversion": ["ConvertIssue", "PlanAffectingConvert"],
    "missing_index": ["MissingIndex"],
    "spill": ["SpillToTempDb"],
    "memory_grant": ["MemoryGrantWarning"],
    "key_lookup": ["Lookup=&quot;1&quot;", "Lookup=\"1\""],
}


def marker_flags(df: DataFrame, text: str, markers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows whose text has any marker, with one 0/1 column per marker group."""
    groups = markers or PLAN_MARKERS
    marked = df.withColumns({n: flag(any_of([F.col(text).contains(m) for m in ms]))
                             for n, ms in groups.items()})
    return marked.filter(any_of([F.col(n) == 1 for n in groups]))


def marker_summary(flagged: DataFrame, by: Sequence[str], markers: Sequence[str]) -> DataFrame:
    return flagged.groupBy(*by).agg(row_count().alias("texts"), *[F.sum(m).alias(m) for m in markers])


def replica_flags(df: DataFrame, connected: str, health: str, mode: str, operational: str,
                  role: str, error_time: str, as_of) -> DataFrame:
    """Replica state flags: disconnected goes before unhealthy, recent means 24 hours."""
    conn, ok = F.col(connected), F.col(health)
    sync = F.col(mode) == "SYNCHRONOUS_COMMIT"
    recent = F.col(error_time) >= before(as_of, hours=24)
    return df.withColumns({
        "replica_flag": band([(conn != "CONNECTED", "DISCONNECTED_REPLICA"),
                              (ok != "HEALTHY", "UNHEALTHY_REPLICA")], ""),
        "commit_flag": band([(sync & (conn != "CONNECTED"), "SYNC_COMMIT_DISCONNECTED"),
                             (sync & (ok != "HEALTHY"), "SYNC_COMMIT_NOT_HEALTHY")], ""),
        "lease_flag": band([
            ((conn == "DISCONNECTED") & recent, "RECENT_DISCONNECT"),
            (conn == "DISCONNECTED", "DISCONNECTED"),
            (~F.col(operational).isin("ONLINE", "ONLINE_IN_PROGRESS") & (F.col(role) != "RESOLVING"), "OPERATIONAL_STATE_WARN"),
            (recent & (conn == "CONNECTED"), "RECENT_ERROR_NOW_CONNECTED")], ""),
    })


def readiness(df: DataFrame, failover: str, connected: str, health: str) -> DataFrame:
    """Can the replica take over?"""
    auto, conn, ok = F.col(failover) == "AUTOMATIC", F.col(connected), F.col(health)
    return df.withColumn("failover_readiness", band([
        (auto & (conn == "CONNECTED") & (ok == "HEALTHY"), "FAILOVER_READY"),
        (auto & (conn != "CONNECTED"), "NOT_READY_DISCONNECTED"),
        (auto & (ok != "HEALTHY"), "NOT_READY_UNHEALTHY"),
        (F.col(failover) == "MANUAL", "MANUAL_FAILOVER_ONLY")], ""))


def age_flags(df: DataFrame, ts: str, as_of, limits: Sequence[int] = (15, 60), unit: str = "minute",
              size: str | None = None, size_limit: int = 1 << 30) -> DataFrame:
    """Age of open work and one flag per limit; with `size` also a size flag."""
    age = boundary_diff(unit, F.col(ts), instant(as_of))
    out = {"age": age, **{f"flag_over_{n}_{unit}": flag(age >= n) for n in limits}}
    if size:
        out["flag_over_size"] = flag(F.col(size) >= size_limit)
    return df.withColumns(out)
