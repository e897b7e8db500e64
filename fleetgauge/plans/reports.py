"""Whole reports, composed of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import any_of, band, flag, keyword_pattern, keyword_rank, label_of, like_any
from fleetgauge.functions.numbers import percent, row_count, whole_ratio
from fleetgauge.functions.times import before, boundary_diff, instant
from fleetgauge.operators import aggregates, rules, windows
from fleetgauge.operators.skew import salted_join


def backup_coverage(databases: DataFrame, history: DataFrame, keys: Sequence[str], kind: str, finish: str,
                    model: str, as_of, detail: Mapping[str, str] | None = None, size: str | None = None,
                    codes: Sequence[str] = ("D", "I", "L")) -> DataFrame:
    """Latest full, differential and log backup per database, and what is missing.

    All three come from one pass over the history: the latest rows per database and type.
    Backups that finished at the same moment all stay, so a database may have several rows.
    """
    keys = list(keys)
    cols = dict(detail or {})
    if size:
        cols[size] = "size"
    names = dict(zip(codes, ("full", "diff", "log")))
    latest = windows.latest_ties(history.filter(F.col(kind).isin(*codes)).select(*keys, kind, finish, *cols), [*keys, kind], finish)
    out = databases
    for code, name in names.items():
        part = latest.filter(F.col(kind) == code).select(
            *keys, F.col(finish).alias(f"last_{name}"), *[F.col(c).alias(f"last_{name}_{a}") for c, a in cols.items()])
        out = out.join(part, keys, "left")
    return out.withColumns({
        "flag_no_backup": flag(F.col("last_full").isNull()),
        "flag_no_recent_log": flag((F.col(model) == "FULL") & (
            F.col("last_log").isNull() | (F.col("last_log") < before(as_of, hours=24)))),
    })


class Recoverability(NamedTuple):
    chain: DataFrame
    exposure: DataFrame
    retention: DataFrame
    throughput: DataFrame


def recoverability(databases: DataFrame, history: DataFrame, keys: Sequence[str], kind: str, start: str, finish: str,
                   first: str, last: str, base: str, attr: str, copy_only: Column, size: Column, seconds: Column,
                   model: str, as_of, tie: Sequence[str], codes: Sequence[str] = ("D", "I", "L"),
                   hot_rows: int | None = None) -> Recoverability:
    """Chain audit (30 days), recovery-point exposure (90 days), retention and throughput."""
    recent = history.filter(F.col(start) >= before(as_of, days=30))
    chain = windows.chain_audit(recent, keys, kind, start, first, last, base, attr, copy_only, tie, codes, hot_rows)
    logs = history.filter((F.col(kind) == codes[2]) & (F.col(finish) >= before(as_of, days=90)))
    stats = windows.gap_stats(windows.gaps(logs, keys, finish, tie=tie, hot_rows=hot_rows), keys, finish)
    fulls = history.filter(F.col(kind) == codes[0])
    return Recoverability(
        chain, windows.exposure(databases, stats, keys, as_of, model),
        aggregates.age_buckets(history, [*keys, kind], finish, as_of),
        windows.last_n_stats(fulls, keys, [F.desc(finish), *[F.desc(t) for t in tie]], finish, size, seconds))


def rto_indicators(databases: DataFrame, files: DataFrame, history: DataFrame, segments: DataFrame, keys: Sequence[str],
                   pages: Column, kind: str, start: str, finish: str, size: Column, as_of,
                   codes: Sequence[str] = ("D", "L")) -> DataFrame:
    """What drives restore time: data size, last full, log volume of 24 hours, log segments."""
    keys = list(keys)
    data = files.groupBy(*keys).agg(F.sum(pages).alias("data_size"))
    full = (windows.latest_ties(history.filter(F.col(kind) == codes[0]).select(*keys, start, finish), keys, finish)
            .select(*keys, F.col(finish).alias("last_full"), boundary_diff("second", F.col(start), F.col(finish)).alias("last_full_sec")))
    logs = (history.filter((F.col(kind) == codes[1]) & (F.col(finish) >= before(as_of, hours=24)))
            .groupBy(*keys).agg(F.sum(size).alias("log_volume_24h"), row_count().alias("log_backups_24h")))
    segs = segments.groupBy(*keys).agg(row_count().alias("segments"))
    out = databases
    for part in (data, full, logs, segs):
        out = out.join(part, keys, "left")
    n = F.col("segments")
    return out.withColumn("segment_rating", F.when(n.isNotNull(), band(rules.segment_ladder(n), "Critical")))


def wait_profile(df: DataFrame, wait: str, tasks: str, total: str, signal: str, longest: str,
                 names: Sequence[str] = rules.IDLE_WAITS, patterns: Sequence[str] = rules.IDLE_WAIT_PATTERNS,
                 categories=None, by: Sequence[str] = ()) -> DataFrame:
    """Waits without the idle ones: means, resource time, share of the rest, category."""
    busy = rules.exclude(df.filter(F.col(total) > 0), wait, names, patterns)
    shared = windows.share(busy, total, by)
    ladder = (categories or rules.wait_category)(F.col(wait), F.col(total), F.col(signal))
    return shared.select(*by, wait, tasks, total, signal, longest, "share_pct",
                         (F.col(total) - F.col(signal)).alias("resource"),
                         F.coalesce(whole_ratio(F.col(total), F.col(tasks)), F.lit(0).cast("decimal(18,2)")).alias("mean_wait"),
                         band(ladder, "OTHER").alias("category"))


def job_reliability(jobs: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, status: str, seconds: Column,
                    as_of, codes: Mapping[str, object] | None = None, days: int = 90) -> DataFrame:
    """Run counts, failure share, last status and duration outliers per job.

    The mean duration is cut to whole seconds, as the comparison max > 3 x mean expects.
    """
    c = codes or {"successful": 1, "failed": 0, "retry": 2, "cancelled": 3}
    keys = list(keys)
    window = history.filter(F.col(ts) >= before(as_of, days=days))
    d = seconds.cast("bigint")
    stats = window.groupBy(*keys).agg(
        row_count().alias("total_runs"), *[aggregates.count_if(F.col(status) == v).alias(n) for n, v in c.items()],
        F.floor(F.sum(d) / F.count(d)).cast("bigint").alias("mean_sec"), F.max(d).alias("max_sec"), F.min(d).alias("min_sec"),
        F.max(F.struct(F.col(ts).alias("t"), F.col(status).alias("s"))).alias("_m"))
    stats = stats.withColumns({"last_run": F.col("_m.t"), "last_status": F.col("_m.s"),
                               "failure_ratio_pct": percent(F.col("failed"), F.col("total_runs"))}).drop("_m")
    out = jobs.join(stats, keys, "left")
    n = F.col("total_runs")
    return out.withColumns({
        "flag_no_history": flag(n.isNull()),
        "flag_no_success": flag((n > 0) & (F.col("successful") == 0)),
        "flag_high_failure": flag(F.col("failure_ratio_pct") > 20),
        "flag_last_failed": flag(F.col("last_status") == F.lit(c["failed"])),
        "flag_duration": flag(F.col("max_sec") > F.col("mean_sec") * 3),
        **{m: F.coalesce(m, F.lit(0)) for m in ("total_runs", *c)},
        "failure_ratio_pct": F.coalesce("failure_ratio_pct", F.lit(0).cast("decimal(18,2)")),
    })


def silent_failures(steps: DataFrame, runs: DataFrame, keys: Sequence[str], day: str, step_failed: Column,
                    run_succeeded: Column, hot_rows: int | None = None) -> DataFrame:
    """Failed steps on a day on which a run of the job succeeded."""
    good = runs.filter(run_succeeded).select(*keys, day).distinct()
    return salted_join(steps.filter(step_failed), good, [*keys, day], "left_semi", hot_rows)


def job_inventory(jobs: DataFrame, steps: DataFrame, schedules: DataFrame, history: DataFrame, keys: Sequence[str],
                  enabled: str, schedule_on: Column, next_run: str, last: str, status: str, tie: Sequence[str] = ()) -> DataFrame:
    """Jobs with step and schedule counts, next and last run, and what is odd about them."""
    keys = list(keys)
    s = steps.groupBy(*keys).agg(row_count().alias("steps"))
    c = schedules.filter(schedule_on).groupBy(*keys).agg(row_count().alias("schedules"), F.min(next_run).alias("next_run"))
    h = (windows.latest(history.select(*keys, last, status, *tie), keys, [F.desc(last), *[F.desc(t) for t in tie]])
         .select(*keys, F.col(last).alias("last_run"), F.col(status).alias("last_status")))
    out = jobs.join(s, keys, "left").join(c, keys, "left").join(h, keys, "left")
    out = out.withColumns({"steps": F.coalesce("steps", F.lit(0)), "schedules": F.coalesce("schedules", F.lit(0))})
    on, never = F.col(enabled) == 1, F.col("last_run").isNull()
    return out.withColumns({
        "flag_no_schedule": flag(F.col("schedules") == 0), "flag_never_run": flag(never),
        "flag_enabled_never_run": flag(on & never), "flag_disabled_scheduled": flag(~on & (F.col("schedules") > 0))})


def maintenance_effect(runs: DataFrame, keys: Sequence[str], command: str, day: str, status: str, message: str,
                       success, scope: Sequence[str] = rules.MAINTENANCE_SCOPE, categories=None,
                       zero_patterns: Sequence[str] = ("%Processed 0%",)) -> DataFrame:
    """Maintenance runs per job and command: failures, last run, success that did nothing.

    The last status is that of the last run day; on ties the largest one counts.
    """
    ladder = (categories or rules.maintenance_category)(F.col(command))
    ok = F.col(status) == success
    nothing = ok & like_any(F.col(message), zero_patterns, ignore_case=True)
    kept = runs.filter(like_any(F.col(command), scope, ignore_case=True)).withColumn("category", band(ladder, "OTHER"))
    out = kept.groupBy(*keys, "category").agg(
        row_count().alias("total_runs"), aggregates.count_if(ok).alias("successes"), aggregates.count_if(~ok).alias("failures"),
        F.max(F.struct(F.col(day).alias("d"), F.col(status).alias("s"))).alias("_m"), F.max(flag(nothing)).alias("_z"))
    return out.select(*keys, "category", "total_runs", "successes", "failures", F.col("_m.d").alias("last_run_day"),
                      F.col("_m.s").alias("last_status"),
                      F.when(F.col("failures") > 0, "HAS_FAILURES").otherwise("").alias("failure_flag"),
                      F.when(F.col("_z") == 1, "SUCCESS_ZERO_PROCESSED").otherwise("").alias("zero_flag"))


# Keywords of I/O and corruption lines, in order of precedence, and severities.
LOG_RULES = [
    ("823", "823 - Hard I/O Error", "CRITICAL"), ("824", "824 - Logical Consistency Error", "CRITICAL"),
    ("825", "825 - Read Retry (intermittent hardware)", "WARNING"), ("832", "832 - Constant Page Violation", "CRITICAL"),
    ("torn page", "Torn Page Detection", "INVESTIGATE"), ("checksum", "Checksum Failure", "INVESTIGATE"),
    ("I/O error", "I/O Error (generic)", "INVESTIGATE"), ("corrupt", "Corruption Keyword", "INVESTIGATE"),
    ("damaged", "Damaged Keyword", "INVESTIGATE"), ("bad page", "Bad Page Keyword", "INVESTIGATE"),
]
# What the error-log searches look for, where it is narrower than the class.
LOG_SEARCH = ["Error: 823", "Error: 824", "Error: 825", "Error: 832", "checksum", "torn page", "I/O error",
              "corrupt", "damaged", "bad page"]
SEVERITIES = ["CRITICAL", "WARNING", "INVESTIGATE"]


def log_errors(lines: DataFrame, ts: str, text: str, as_of, keep: Sequence[str] = (), rule_list=None,
               search: Sequence[str] | None = None) -> DataFrame:
    """Distinct log lines that hold any searched keyword, with class (first match wins),
    severity (the worst of any matching keyword) and age in days.

    All words are one pattern, so a line is searched once for the filter, and a line that is kept once for
    the class and once for the severity, whatever the number of words.
    """
    table = rule_list or LOG_RULES
    words = search or (LOG_SEARCH if rule_list is None else [w for w, _, _ in table])
    first, worst = {}, {}
    for i, (word, _, severity) in enumerate(table):
        first.setdefault(word.lower(), i)
        worst[word.lower()] = min(worst.get(word.lower(), len(SEVERITIES)), SEVERITIES.index(severity))
    lowered = F.lower(F.col(text))
    named = lambda labels, rank, default: F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), rank), F.lit(default))
    return (lines.filter(lowered.rlike(keyword_pattern([w.lower() for w in words]))).select(*keep, ts, text).distinct()
            .withColumns({"error_class": named([label for _, label, _ in table], keyword_rank(lowered, first), "Other"),
                          "severity": named(SEVERITIES, keyword_rank(lowered, worst), "INVESTIGATE"),
                          "days_ago": boundary_diff("day", F.col(ts), instant(as_of))}))


def check_history(databases: DataFrame, lines: DataFrame, keys: Sequence[str], name: str, ts: str, text: str, as_of,
                  tie: Sequence[str] = (), overdue_days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Latest integrity check per database, read from log lines, with missing, failed and
    overdue flags. `keys` is the database name column of `databases`; `name` of the lines is
    the text between the first parentheses."""
    t = F.col(text)
    outcome = band([(t.contains("found 0 errors"), "CLEAN"),
                    (t.contains("errors found") | t.rlike("found [1-9][0-9]* errors"), "ERRORS_FOUND"),
                    (t.contains("CHECKDB"), "UNKNOWN")], "OTHER")
    parsed = (lines.filter(t.contains("DBCC CHECKDB (")).select(
        *by, F.trim(F.regexp_extract(t, r"\(([^)]*)\)", 1)).alias(name), ts, outcome.alias("outcome"), *tie))
    counted = parsed.groupBy(*by, name).agg(row_count().alias("log_entries"))
    last = windows.latest(parsed, [*by, name], [F.desc(ts), *[F.desc(c) for c in tie]])
    out = databases.join(counted, [*by, *keys], "left").join(last.drop(*tie), [*by, *keys], "left")
    days = boundary_diff("day", F.col(ts), instant(as_of))
    return out.withColumns({
        "days_since_check": days,
        "missing_flag": F.when(F.col("log_entries").isNull(), "NO_CHECKDB_IN_LOG").otherwise(""),
        "error_flag": F.when(F.col("outcome") == "ERRORS_FOUND", "ERRORS_FOUND").otherwise(""),
        "overdue_flag": F.when((days > overdue_days) | F.col("log_entries").isNull(), "OVERDUE").otherwise(""),
    }).withColumnRenamed(ts, "last_check")


# Fixed value: storage and cluster providers of host event logs.
STORAGE_PROVIDERS = "disk|stor|ntfs|vol|mpio|iscsi|cluster|whea|kernel|memory"


def host_events(df: DataFrame, ts: str, provider: str, level: str, message: str, as_of, providers: str = STORAGE_PROVIDERS,
                levels: Sequence = (1, 2, 3), days: int = 90) -> DataFrame:
    """Host events of a time window by level and provider, line breaks turned into blanks."""
    return (df.filter((F.col(ts) >= before(as_of, days=days)) & F.col(level).isin(*levels)
                      & F.lower(F.col(provider)).rlike(providers.lower()))
            .withColumn(message, F.regexp_replace(F.col(message), r"\r?\n", " ")))


def damage_report(df: DataFrame, event: str, errors: str, ts: str, as_of, recent_days: int = 30) -> DataFrame:
    """Damaged pages: open or resolved, recurring, recent."""
    e, days = F.col(event), boundary_diff("day", F.col(ts), instant(as_of))
    return df.withColumns({
        "event_label": label_of(e, rules.PAGE_EVENT, unknown=None),
        "resolution": band([(e.isin(1, 2, 3), "UNRESOLVED"), (e.isin(4, 5, 7), "RESOLVED")], "UNKNOWN"),
        "days_since_event": days,
        "unresolved_flag": F.when(e.isin(1, 2, 3), "UNRESOLVED_CORRUPTION").otherwise(""),
        "recurring_flag": F.when(F.col(errors) > 1, "RECURRING_ERRORS").otherwise(""),
        "recent_flag": F.when(days <= recent_days, "RECENT_EVENT").otherwise("")})


def volume_bands(df: DataFrame, keys: Sequence[str], size: Column, free: Column) -> DataFrame:
    """Free percent per host and volume; below 10 critical, below 15 warning."""
    out = df.groupBy(*keys).agg(F.sum(size).alias("size"), F.sum(free).alias("free"))
    p = percent(F.col("free"), F.col("size"), 1, zero=0)
    return out.withColumn("free_pct", p).withColumn(
        "space_flag", band([(F.col("free_pct") < 10, "CRITICAL"), (F.col("free_pct") < 15, "WARNING")], "OK"))


def login_policy(df: DataFrame, password_hash: str, last_set: str, policy: str, expiration: str, disabled: str, as_of) -> DataFrame:
    """Hash version from the leading bytes (hex text), password age and all policy flags."""
    lead = F.upper(F.substring(F.col(password_hash), 1, 4))
    days = boundary_diff("day", F.col(last_set), instant(as_of))
    on = lambda c, label: F.when(c, label)
    return df.withColumns({
        "hash_version": band([(lead == "0100", "LEGACY_SHA1_HASH"), (lead == "0200", "SHA2_HASH")], "UNKNOWN_OR_HASHED_EXTERNALLY"),
        "password_age_days": days,
        "policy_flags": F.concat_ws(" ", on(F.col(policy) == 0, "POLICY_DISABLED"), on(F.col(expiration) == 0, "EXPIRY_DISABLED"),
                                    on(lead == "0100", "WEAK_HASH"), on(days > 365, "PASSWORD_OLD_1Y"),
                                    on(F.col(disabled) == 1, "DISABLED"))})


class Privileges(NamedTuple):
    members: DataFrame
    permissions: DataFrame
    builtin: DataFrame


# Permissions that amount to control of the server, and built-in accounts.
HIGH_PRIVILEGES = ["CONTROL SERVER", "ALTER ANY LOGIN", "IMPERSONATE ANY LOGIN", "ALTER ANY SERVER ROLE",
                   "CREATE ANY DATABASE", "ALTER ANY LINKED SERVER", "ADMINISTER BULK OPERATIONS",
                   "EXTERNAL ACCESS ASSEMBLY", "UNSAFE ASSEMBLY"]
BUILTIN_ACCOUNTS = ["BUILTIN\\Administrators", "NT AUTHORITY\\SYSTEM", "NT AUTHORITY\\NETWORK SERVICE"]


def privileges(principals: DataFrame, members: DataFrame, permissions: DataFrame, by: Sequence[str] = (),
               high: Sequence[str] = HIGH_PRIVILEGES, builtin: Sequence[str] = BUILTIN_ACCOUNTS) -> Privileges:
    """Role members, server permissions and built-in accounts.

    Columns: principals(principal_id, name, type, is_disabled), members(role_principal_id,
    member_principal_id), permissions(permission_name, grantee_principal_id).
    """
    names = lambda p: principals.select(*by, F.col("principal_id").alias(f"{p}_principal_id"), F.col("name").alias(f"{p}_name"),
                                        F.col("type").alias(f"{p}_type"), F.col("is_disabled").alias(f"{p}_disabled"))
    role = names("role").drop("role_type", "role_disabled")
    m = members.join(role, [*by, "role_principal_id"]).join(names("member"), [*by, "member_principal_id"])
    person = (~like_any(F.col("member_name"), ["NT %", "%\\%"]) & (F.col("member_type") == "S") & (F.col("member_name") != "sa"))
    m = m.withColumns({"disabled_flag": F.when(F.col("member_disabled") == 1, "DISABLED_MEMBER").otherwise(""),
                       "personal_flag": F.when(person, "POSSIBLE_PERSONAL_ACCOUNT").otherwise("")})
    p = permissions.join(names("grantee"), [*by, "grantee_principal_id"]).withColumn(
        "high_privilege_flag", F.when(F.col("permission_name").isin(*high), "HIGH_PRIVILEGE").otherwise(""))
    first = F.col("principal_id") == 1
    b = principals.filter(first | F.col("name").isin(*builtin)).select(
        *by, "principal_id", "name", "is_disabled",
        F.when(first & (F.col("name") == "sa"), "ORIGINAL_SA").when(first, "RENAMED_SA").otherwise("BUILTIN_ADMIN").alias("account_flag"))
    return Privileges(m, p, b)


def expiry_report(sources: Mapping[str, DataFrame], expiry: str, as_of, by: Sequence[str] = ()) -> DataFrame:
    """Certificates of all sources by expiry band: how many, and the next to expire."""
    from fleetgauge.operators.sets import append_branches
    every = append_branches({n: df.select(*by, expiry) for n, df in sources.items()}, "cert_source")
    label = band(rules.expiry_ladder(F.col(expiry), as_of), "OK")
    return every.groupBy(*by, "cert_source", label.alias("expiry_flag")).agg(
        row_count().alias("certificates"), F.min(expiry).alias("first_expiry"),
        F.min(boundary_diff("day", instant(as_of), F.col(expiry))).alias("fewest_days_left"))
