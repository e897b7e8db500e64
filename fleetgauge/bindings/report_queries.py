"""Whole reports and findings on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.history_queries import _AUDIT, chain_rows
from fleetgauge.bindings.registry import EVENTS_NOW, ORDERS_NOW, bind, cents, half_up
from fleetgauge.functions.numbers import row_count
from fleetgauge.operators import rules
from fleetgauge.operators.aggregates import count_by
from fleetgauge.plans import findings, reports

KIND = "CASE event_type WHEN 'signup' THEN 'D' WHEN 'purchase' THEN 'I' WHEN 'view' THEN 'L' ELSE 'X' END"


def _users(t):
    return t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "SIMPLE").otherwise("FULL").alias("model"))


@bind("cmp1_backup_coverage", f"""
WITH h AS (SELECT user_id, ts, value, {KIND} AS kind FROM events), m AS (SELECT user_id, kind, max(ts) AS ts FROM h GROUP BY 1, 2), l AS (SELECT h.* FROM h JOIN m USING (user_id, kind, ts))
SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SIMPLE' ELSE 'FULL' END AS model, f.ts AS last_full, f.value AS last_full_size, d.ts AS last_diff, d.value AS last_diff_size, g.ts AS last_log, g.value AS last_log_size,
  CASE WHEN f.ts IS NULL THEN 1 ELSE 0 END AS flag_no_backup, CASE WHEN c_mktsegment <> 'BUILDING' AND coalesce(g.ts, TIMESTAMP '1900-01-01') < TIMESTAMP '2024-01-30 00:00:00' THEN 1 ELSE 0 END AS flag_no_recent_log
FROM customer LEFT JOIN l f ON f.user_id = c_custkey AND f.kind = 'D' LEFT JOIN l d ON d.user_id = c_custkey AND d.kind = 'I' LEFT JOIN l g ON g.user_id = c_custkey AND g.kind = 'L'""")
def cmp1(t):
    kind = F.when(F.col("event_type") == "signup", "D").when(F.col("event_type") == "purchase", "I").when(F.col("event_type") == "view", "L").otherwise("X")
    return reports.backup_coverage(_users(t), t.events.withColumn("kind", kind), ["user_id"], "kind", "ts", "model", EVENTS_NOW, size="value")


def _recoverability(t):
    history = chain_rows(t).withColumns({"size": F.col("event_id") * 3, "seconds": F.col("event_id") % 400})
    return reports.recoverability(_users(t), history, ["user_id"], "kind", "ts", "ts", "first_mark", "last_mark", "base", "model", F.col("copy_only"),
                                  F.col("size"), F.col("seconds"), "model", EVENTS_NOW, ["event_id"])


@bind("cmp2_chain", _AUDIT.replace("FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00')"))
def cmp2a(t):
    return _recoverability(t).chain.select("event_id", "user_id", "ts", "kind", "anomaly", "note")


@bind("cmp2_exposure", f"""
WITH g AS (SELECT user_id, ts, date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events WHERE event_type = 'view'),
 s AS (SELECT user_id, count(*) AS events, sum(gap) AS total, max(gap) AS max_gap, max(ts) AS last_event, count(*) FILTER (WHERE gap > 60) AS gaps_over_limit FROM g WHERE gap IS NOT NULL GROUP BY 1),
 u AS (SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SIMPLE' ELSE 'FULL' END AS model FROM customer)
SELECT user_id, model, s.events, {half_up('total', 's.events', 1)} AS mean_gap, max_gap, last_event, gaps_over_limit, date_diff('minute', last_event, TIMESTAMP '{EVENTS_NOW}') AS minutes_since_last,
 CASE WHEN model = 'FULL' AND max_gap > 60 THEN 1 ELSE 0 END AS flag_missed_window, CASE WHEN model = 'FULL' AND (last_event IS NULL OR date_diff('minute', last_event, TIMESTAMP '{EVENTS_NOW}') > total / s.events) THEN 1 ELSE 0 END AS flag_exposed,
 CASE WHEN model = 'FULL' AND last_event IS NULL THEN 1 ELSE 0 END AS flag_no_event FROM u LEFT JOIN s USING (user_id)""")
def cmp2b(t):
    return _recoverability(t).exposure


@bind("cmp2_retention", f"""
SELECT user_id, {KIND} AS kind, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS last_7d, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-24' AND ts >= TIMESTAMP '2024-01-01') AS day_8_to_30,
 CAST(0 AS BIGINT) AS day_31_to_90, CAST(0 AS BIGINT) AS day_91_plus, count(*) AS total, CASE WHEN count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') > 100 THEN 1 ELSE 0 END AS flag_excessive FROM events GROUP BY 1, 2""")
def cmp2c(t):
    return _recoverability(t).retention


@bind("cmp2_throughput", f"""
SELECT user_id, count(*) AS runs, {half_up('sum(3 * event_id)', 'count(*)')} AS mean_size, {half_up('sum(event_id % 400)', 'count(*)', 1)} AS mean_sec, {half_up('sum(3 * event_id)', 'sum(event_id % 400)')} AS throughput, min(ts) AS oldest, max(ts) AS newest
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup') WHERE n <= 10 GROUP BY 1""")
def cmp2d(t):
    return _recoverability(t).throughput


_NATION_ORDERS = "(SELECT c_nationkey AS n_nationkey, o.* FROM orders o JOIN customer ON c_custkey = o_custkey)"


@bind("cmp3_rto_indicators", f"""
WITH o AS {_NATION_ORDERS}, f AS (SELECT n_nationkey, o_orderdate, o_orderkey % 5000 AS sec FROM o WHERE o_orderstatus = 'O' AND (n_nationkey, o_orderdate) IN (SELECT n_nationkey, max(o_orderdate) FROM o WHERE o_orderstatus = 'O' GROUP BY 1)),
 l AS (SELECT n_nationkey, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS v, count(*) AS n FROM o WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-07-10 00:00:00' - INTERVAL 24 HOUR GROUP BY 1), s AS (SELECT n_nationkey, count(*) AS n FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT nation.n_nationkey, d.p AS data_size, f.o_orderdate AS last_full, sec AS last_full_sec, l.v AS log_volume_24h, l.n AS log_backups_24h, s.n AS segments,
 CASE WHEN s.n < 100 THEN 'OK' WHEN s.n < 500 THEN 'Moderate' WHEN s.n < 1000 THEN 'High' WHEN s.n >= 1000 THEN 'Critical' END AS segment_rating
FROM nation LEFT JOIN (SELECT s_nationkey, CAST(sum(CAST(floor(s_acctbal) AS BIGINT)) AS BIGINT) AS p FROM supplier GROUP BY 1) d ON s_nationkey = nation.n_nationkey LEFT JOIN f ON f.n_nationkey = nation.n_nationkey
LEFT JOIN l ON l.n_nationkey = nation.n_nationkey LEFT JOIN s ON s.n_nationkey = nation.n_nationkey""")
def cmp3(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "n_nationkey")
    o = o.withColumn("start", F.expr("o_orderdate - make_dt_interval(0, 0, 0, o_orderkey % 5000)"))
    return reports.rto_indicators(t.nation.select("n_nationkey"), t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), o.replace({"O": "D", "F": "L"}, subset="o_orderstatus"),
                                  o.filter("o_orderpriority = '1-URGENT'"), ["n_nationkey"], F.floor("s_acctbal"), "o_orderstatus", "start", "o_orderdate",
                                  F.round(F.col("o_totalprice") * 100).cast("bigint"), "2001-07-10 00:00:00")


WAITS = {1: "SLEEPX_TASK", 2: "PAGEIOLATCH_SH", 3: "LCK_M_X", 4: "THREADPOOL", 5: "WAITFOR", 6: "BACKUPIO", 7: "XTP_OTHER"}
_WAIT_SQL = "CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WAITS.items()) + " END"


@bind("cmp4_wait_profile", f"""
WITH w AS (SELECT l_suppkey, {_WAIT_SQL} AS wait, count(*) AS tasks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS BIGINT) - 3 * CAST(l_quantity > 3 AS BIGINT) ELSE 1 END) AS BIGINT) AS signal, max(CAST(l_quantity AS BIGINT)) AS longest
  FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM w WHERE wait NOT IN ('SLEEPX_TASK', 'WAITFOR'))
SELECT l_suppkey, wait, tasks, total, signal, longest, {half_up('total', 'sum(total) OVER (PARTITION BY l_suppkey)', 2, 100)} AS share_pct, total - signal AS resource, {half_up('total', 'tasks')} AS mean_wait,
  CASE WHEN wait = 'THREADPOOL' OR signal * 10 > total * 7 THEN 'CPU' ELSE CASE wait WHEN 'PAGEIOLATCH_SH' THEN 'IO' WHEN 'LCK_M_X' THEN 'LOCK' WHEN 'BACKUPIO' THEN 'BACKUP' ELSE 'OTHER' END END AS category FROM k""")
def cmp4(t):
    q = F.col("l_quantity").cast("bigint")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in WAITS.items() for x in kv]), F.col("l_linenumber"))
    signal = F.when(F.col("l_suppkey") % 3 == 0, q - F.when(q > 3, 3).otherwise(0)).otherwise(1)
    waits = t.lineitem.groupBy("l_suppkey", name.alias("wait")).agg(row_count().alias("tasks"), F.sum(q).alias("total"), F.sum(signal).alias("signal"), F.max(q).alias("longest"))
    return reports.wait_profile(waits, "wait", "tasks", "total", "signal", "longest", by=["l_suppkey"])


@bind("cmp5_job_reliability", f"""
WITH h AS (SELECT *, o_orderkey % 1000 AS d FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 1000 DAY), m AS (SELECT o_custkey, max(o_orderdate) AS t FROM h GROUP BY 1),
 s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS ok, count(*) FILTER (WHERE o_orderstatus = 'F') AS bad, count(*) FILTER (WHERE o_orderstatus = 'P') AS retry, CAST(sum(d) // count(*) AS BIGINT) AS mean, max(d) AS mx, min(d) AS mn,
   any_value(t) AS t, max(o_orderstatus) FILTER (WHERE o_orderdate = t) AS st FROM h JOIN m USING (o_custkey) GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(n, 0) AS total_runs, coalesce(ok, 0) AS successful, coalesce(bad, 0) AS failed, coalesce(retry, 0) AS retry, mean AS mean_sec, mx AS max_sec, mn AS min_sec, t AS last_run, st AS last_status,
 coalesce({half_up('bad', 'n', 2, 100)}, 0) AS failure_ratio_pct, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS flag_no_history, CASE WHEN n > 0 AND ok = 0 THEN 1 ELSE 0 END AS flag_no_success, CASE WHEN bad * 5 > n THEN 1 ELSE 0 END AS flag_high_failure,
 CASE WHEN st = 'F' THEN 1 ELSE 0 END AS flag_last_failed, CASE WHEN mx > 3 * mean THEN 1 ELSE 0 END AS flag_duration FROM customer LEFT JOIN s ON s.o_custkey = c_custkey""")
def cmp5(t):
    return reports.job_reliability(t.customer.select(F.col("c_custkey").alias("o_custkey")), t.orders, ["o_custkey"], "o_orderdate", "o_orderstatus", F.col("o_orderkey") % 1000, ORDERS_NOW,
                                   {"successful": "O", "failed": "F", "retry": "P"}, 1000)


@bind("cmp6_silent_failures", """
SELECT l_suppkey, day, count(*) AS rows FROM (SELECT l_suppkey, l_orderkey, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R') s
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.l_suppkey AND o.o_orderstatus = 'O' AND CAST(o.o_orderdate AS DATE) = s.day) GROUP BY 1, 2""")
def cmp6(t):
    steps = t.lineitem.withColumn("day", F.to_date("l_shipdate"))
    runs = t.orders.select(F.col("o_custkey").alias("l_suppkey"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return count_by(reports.silent_failures(steps, runs, ["l_suppkey"], "day", F.col("l_returnflag") == "R", F.col("o_orderstatus") == "O"), ["l_suppkey", "day"])


@bind("cmp7_job_inventory", """
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority < '3' GROUP BY 1),
 h AS (SELECT o_custkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal > 2000 THEN 1 ELSE 0 END AS enabled, coalesce(s.n, 0) AS steps, coalesce(c.n, 0) AS schedules, c.d AS next_run, h.o_orderdate AS last_run, h.o_orderpriority AS last_status,
 CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS flag_no_schedule, CASE WHEN h.o_custkey IS NULL THEN 1 ELSE 0 END AS flag_never_run, CASE WHEN c_acctbal > 2000 AND h.o_custkey IS NULL THEN 1 ELSE 0 END AS flag_enabled_never_run,
 CASE WHEN c_acctbal <= 2000 AND c.n > 0 THEN 1 ELSE 0 END AS flag_disabled_scheduled
FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN h ON h.o_custkey = c_custkey""")
def cmp7(t):
    jobs = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 2000, 1).otherwise(0).alias("enabled"))
    o = t.orders
    return reports.job_inventory(jobs, o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F' AND o_totalprice > 200000"), ["o_custkey"], "enabled",
                                 F.col("o_orderpriority") < "3", "o_orderdate", "o_orderdate", "o_orderpriority", ["o_orderkey"])


@bind("cmp8_maintenance_effect", """
WITH r AS (SELECT source, CASE WHEN contains(lower(text), 'license') THEN 'LICENSE' WHEN contains(lower(text), 'token') THEN 'TOKEN' ELSE 'OTHER' END AS category, doc_id // 100 AS day, quality, lang FROM documents JOIN labels USING (doc_id)
  WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), 'e'))
SELECT source, category, count(*) AS total_runs, count(*) FILTER (WHERE quality = 1) AS successes, count(*) FILTER (WHERE quality <> 1) AS failures, max(day) AS last_run_day, max(quality) FILTER (WHERE day = m) AS last_status,
 CASE WHEN bool_or(quality <> 1) THEN 'HAS_FAILURES' ELSE '' END AS failure_flag, CASE WHEN bool_or(quality = 1 AND lang = 'de') THEN 'SUCCESS_ZERO_PROCESSED' ELSE '' END AS zero_flag
FROM (SELECT *, max(day) OVER (PARTITION BY source, category) AS m FROM r) GROUP BY 1, 2""")
def cmp8(t):
    runs = t.documents.join(t.labels, "doc_id").withColumn("day", F.floor(F.col("doc_id") / 100))
    ladder = lambda c: [(F.lower(c).contains("license"), "LICENSE"), (F.lower(c).contains("token"), "TOKEN")]
    return reports.maintenance_effect(runs, ["source"], "text", "day", "quality", "lang", 1, ["%license%", "%token%", "%e%"], ladder, ["de"])


@bind("cmp9_log_errors", f"""
SELECT DISTINCT source, TIMESTAMP '2024-01-01' + to_minutes(doc_id // 2 * 7) AS ts, md5(text) AS line, CASE WHEN contains(lower(text), 'license') THEN 'License' WHEN contains(lower(text), 'token') THEN 'Token' ELSE 'Address' END AS error_class,
  CASE WHEN contains(lower(text), 'token') THEN 'CRITICAL' WHEN contains(lower(text), 'license') THEN 'WARNING' ELSE 'INVESTIGATE' END AS severity, date_diff('day', TIMESTAMP '2024-01-01' + to_minutes(doc_id // 2 * 7), TIMESTAMP '{EVENTS_NOW}') AS days_ago
FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(text, '@')""")
def cmp9(t):
    lines = t.documents.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, (doc_id div 2) * 7)"))
    table = [("license", "License", "WARNING"), ("token", "Token", "CRITICAL"), ("@", "Address", "INVESTIGATE")]
    return reports.log_errors(lines, "ts", "text", EVENTS_NOW, ["source"], table).withColumn("line", F.md5("text")).drop("text")


@bind("cmp10_check_history", f"""
WITH l AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'CLEAN' WHEN o_orderstatus = 'F' THEN 'ERRORS_FOUND' ELSE 'UNKNOWN' END AS outcome FROM orders WHERE o_orderpriority < '4')
SELECT c_name, n AS log_entries, o_orderdate AS last_check, outcome, date_diff('day', o_orderdate, TIMESTAMP '2001-08-05') AS days_since_check, CASE WHEN n IS NULL THEN 'NO_CHECKDB_IN_LOG' ELSE '' END AS missing_flag, CASE WHEN outcome = 'ERRORS_FOUND' THEN 'ERRORS_FOUND' ELSE '' END AS error_flag,
 CASE WHEN n IS NULL OR date_diff('day', o_orderdate, TIMESTAMP '2001-08-05') > 7 THEN 'OVERDUE' ELSE '' END AS overdue_flag
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM l GROUP BY 1) c ON c.o_custkey = c_custkey LEFT JOIN (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) x ON x.o_custkey = c_custkey""")
def cmp10(t):
    end = F.when(F.col("o_orderstatus") == "O", "found 0 errors").when(F.col("o_orderstatus") == "F", "found 12 errors").otherwise("stopped")
    text = F.concat(F.lit("DBCC CHECKDB ("), F.format_string("Customer#%09d", "o_custkey"), F.lit(") WITH (x) executed; "), end)
    lines = t.orders.filter("o_orderpriority < '4'").select(F.col("o_orderdate").alias("logged"), "o_orderkey", text.alias("text"))
    return reports.check_history(t.customer.select("c_name"), lines, ["c_name"], "c_name", "logged", "text", "2001-08-05 00:00:00", ["o_orderkey"])


@bind("cmp11_host_events", """
SELECT doc_id, source, n_chars % 5 + 1 AS level, md5(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' ')) AS message FROM documents
WHERE n_chars % 5 + 1 IN (1, 2, 3) AND (contains(source, 'src1') OR contains(source, 'src2')) AND TIMESTAMP '2024-01-01' + to_hours(doc_id) >= TIMESTAMP '2024-01-15' - INTERVAL 10 DAY""")
def cmp11(t):
    rows = t.documents.select("doc_id", "source", (F.col("n_chars") % 5 + 1).alias("level"), F.col("text").alias("message"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, doc_id)").alias("ts"))
    out = reports.host_events(rows, "ts", "source", "level", "message", "2024-01-15 00:00:00", "SRC1|src2", days=10)
    return out.select("doc_id", "source", "level", F.md5("message").alias("message"))


@bind("cmp12_damage_report", f"""
SELECT event_id, CASE e WHEN 1 THEN '823 or 824 error (hard IO error or bad checksum)' WHEN 2 THEN 'Bad checksum' WHEN 3 THEN 'Torn page' WHEN 4 THEN 'Restored' WHEN 5 THEN 'Repaired (DBCC)' WHEN 7 THEN 'Deallocated by DBCC' END AS event_label,
 CASE WHEN e BETWEEN 1 AND 3 THEN 'UNRESOLVED' WHEN e IN (4, 5, 7) THEN 'RESOLVED' ELSE 'UNKNOWN' END AS resolution, date_diff('day', ts, TIMESTAMP '{EVENTS_NOW}') AS days_since_event, CASE WHEN e BETWEEN 1 AND 3 THEN 'UNRESOLVED_CORRUPTION' ELSE '' END AS unresolved_flag,
 CASE WHEN user_id % 3 > 1 THEN 'RECURRING_ERRORS' ELSE '' END AS recurring_flag, CASE WHEN date_diff('day', ts, TIMESTAMP '{EVENTS_NOW}') <= 10 THEN 'RECENT_EVENT' ELSE '' END AS recent_flag FROM (SELECT *, event_id % 9 AS e FROM events)""")
def cmp12(t):
    rows = t.events.select("event_id", (F.col("event_id") % 9).cast("int").alias("e"), (F.col("user_id") % 3).alias("errors"), "ts")
    return reports.damage_report(rows, "e", "errors", "ts", EVENTS_NOW, 10).drop("e", "errors", "ts")


@bind("cmp13_volume_bands", f"""
SELECT l_suppkey, l_linenumber, CAST(sum(s) AS BIGINT) AS size, CAST(sum(f) AS BIGINT) AS free, coalesce({half_up('sum(f)', 'sum(s)', 1, 100)}, 0) AS free_pct,
 CASE WHEN coalesce({half_up('sum(f)', 'sum(s)', 1, 100)}, 0) < 10 THEN 'CRITICAL' WHEN {half_up('sum(f)', 'sum(s)', 1, 100)} < 15 THEN 'WARNING' ELSE 'OK' END AS space_flag
FROM (SELECT l_suppkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 50 END AS s, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) // (l_linenumber + 1) END AS f FROM lineitem) GROUP BY 1, 2""")
def cmp13(t):
    none = F.col("l_suppkey") % 9 == 0
    return reports.volume_bands(t.lineitem, ["l_suppkey", "l_linenumber"], F.when(none, 0).otherwise(50),
                                F.when(none, 0).otherwise(F.floor(F.col("l_quantity") / (F.col("l_linenumber") + 1))))


@bind("cmp14_login_policy", f"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'LEGACY_SHA1_HASH' WHEN 1 THEN 'SHA2_HASH' ELSE 'UNKNOWN_OR_HASHED_EXTERNALLY' END AS hash_version, c_custkey + 5 AS password_age_days,
 trim(CASE WHEN c_nationkey % 2 = 0 THEN 'POLICY_DISABLED ' ELSE '' END || CASE WHEN c_nationkey % 3 = 0 THEN 'EXPIRY_DISABLED ' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'WEAK_HASH ' ELSE '' END || CASE WHEN c_custkey + 5 > 365 THEN 'PASSWORD_OLD_1Y ' ELSE '' END
   || CASE WHEN c_acctbal < 0 THEN 'DISABLED' ELSE '' END) AS policy_flags FROM customer""")
def cmp14(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = t.customer.select("c_custkey", F.when(k % 3 == 0, "0100ab").when(k % 3 == 1, "0200cd").alias("hash"), F.expr("timestamp_ntz'2001-12-01' - make_dt_interval(c_custkey + 4, 3)").alias("last_set"),
                             F.when(n % 2 == 0, 0).otherwise(1).alias("policy"), F.when(n % 3 == 0, 0).otherwise(1).alias("expiration"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("disabled"))
    return reports.login_policy(rows, "hash", "last_set", "policy", "expiration", "disabled", ORDERS_NOW).select("c_custkey", "hash_version", "password_age_days", "policy_flags")


_PRINCIPALS = """p AS (SELECT s_suppkey AS id, CASE s_suppkey WHEN 1 THEN 'sa' WHEN 2 THEN 'NT AUTHORITY\\SYSTEM' WHEN 3 THEN 'CORP\\' || s_name ELSE s_name END AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'S' ELSE 'U' END AS kind, CASE WHEN s_acctbal < 1000 THEN 1 ELSE 0 END AS off FROM supplier)"""


def _privileges(t):
    k = F.col("s_suppkey")
    name = F.when(k == 1, "sa").when(k == 2, "NT AUTHORITY\\SYSTEM").when(k == 3, F.concat(F.lit("CORP\\"), F.col("s_name"))).otherwise(F.col("s_name"))
    principals = t.supplier.select(k.alias("principal_id"), name.alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "S").otherwise("U").alias("type"), F.when(F.col("s_acctbal") < 1000, 1).otherwise(0).alias("is_disabled"))
    members = t.customer.select(F.col("c_nationkey").cast("bigint").alias("role_principal_id"), (F.col("c_custkey") % 120).alias("member_principal_id"), "c_custkey")
    permissions = t.part.select(F.when(F.col("p_type") == "PROMO", "CONTROL SERVER").when(F.col("p_type") == "SMALL", "ALTER ANY LOGIN").otherwise(F.col("p_type")).alias("permission_name"), (F.col("p_partkey") % 130).alias("grantee_principal_id"), "p_partkey")
    return reports.privileges(principals, members, permissions)


@bind("cmp15_role_members", f"""WITH {_PRINCIPALS} SELECT c_custkey, r.name AS role_name, m.name AS member_name, CASE WHEN m.off = 1 THEN 'DISABLED_MEMBER' ELSE '' END AS disabled_flag,
 CASE WHEN m.kind = 'S' AND m.name NOT IN ('sa') AND NOT starts_with(m.name, 'NT ') AND NOT contains(m.name, chr(92)) THEN 'POSSIBLE_PERSONAL_ACCOUNT' ELSE '' END AS personal_flag
FROM customer JOIN p r ON r.id = c_nationkey JOIN p m ON m.id = c_custkey % 120""")
def cmp15(t):
    return _privileges(t).members.select("c_custkey", "role_name", "member_name", "disabled_flag", "personal_flag")


@bind("cmp15_permissions", f"""WITH {_PRINCIPALS} SELECT p_partkey, p.name AS grantee_name, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'HIGH_PRIVILEGE' ELSE '' END AS high_privilege_flag FROM part JOIN p ON p.id = p_partkey % 130""")
def cmp15p(t):
    return _privileges(t).permissions.select("p_partkey", "grantee_name", "high_privilege_flag")


@bind("cmp15_builtin_accounts", f"""WITH {_PRINCIPALS} SELECT id AS principal_id, name, off AS is_disabled, CASE id WHEN 1 THEN 'ORIGINAL_SA' ELSE 'BUILTIN_ADMIN' END AS account_flag FROM p WHERE id IN (1, 2)""")
def cmp15b(t):
    return _privileges(t).builtin


_EXPIRY = "(SELECT *, o_orderdate + INTERVAL 4 YEAR AS x FROM orders)"


@bind("cmp16_expiry_report", f"""
SELECT o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'internal' ELSE 'host' END AS cert_source, CASE WHEN x < TIMESTAMP '{ORDERS_NOW}' THEN 'EXPIRED' WHEN d < 30 THEN 'CRITICAL' WHEN d < 90 THEN 'HIGH' WHEN d < 180 THEN 'WARNING' ELSE 'OK' END AS expiry_flag,
 count(*) AS certificates, min(x) AS first_expiry, min(d) AS fewest_days_left FROM (SELECT *, date_diff('day', TIMESTAMP '{ORDERS_NOW}', x) AS d FROM {_EXPIRY}) GROUP BY 1, 2, 3""")
def cmp16(t):
    rows = t.orders.withColumn("x", F.col("o_orderdate") + F.expr("INTERVAL 4 YEAR"))
    return reports.expiry_report({"internal": rows.filter("o_orderstatus = 'O'"), "host": rows.filter("o_orderstatus <> 'O'")}, "x", ORDERS_NOW, ["o_orderpriority"])


def _found(t):
    supplier = rules.apply_rules(t.supplier, {"flag_negative": F.col("s_acctbal") < 0, "flag_low": F.col("s_acctbal") < 500}, []).flagged
    orders = t.orders.withColumn("state_flag", F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "OK").otherwise("")) \
        .withColumn("flag_large", F.when(F.col("o_totalprice") > 450000, 1).otherwise(0))
    return (findings.findings(supplier, "04_01", ["s_nationkey", "s_suppkey"]).unionByName(findings.findings(orders, "17_02", ["o_custkey", "o_orderkey"])))


_FOUND = """(SELECT '04_01' AS check_id, s_nationkey || '/' || s_suppkey AS entity, 'flag_negative' AS flag, '1' AS value FROM supplier WHERE s_acctbal < 0
 UNION ALL SELECT '04_01', s_nationkey || '/' || s_suppkey, 'flag_low', '1' FROM supplier WHERE s_acctbal < 500
 UNION ALL SELECT '17_02', o_custkey || '/' || o_orderkey, 'state_flag', 'FAILED' FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT '17_02', o_custkey || '/' || o_orderkey, 'flag_large', '1' FROM orders WHERE o_totalprice > 450000)"""


@bind("fnd1_findings", f"SELECT * FROM {_FOUND}")
def fnd1(t):
    return _found(t)


@bind("fnd2_score", f"""
SELECT split_part(check_id, '_', 1) AS chapter, CASE flag WHEN 'state_flag' THEN 'High' WHEN 'flag_negative' THEN 'Critical' ELSE 'Informational' END AS severity, count(*) AS findings, count(DISTINCT flag) AS kinds FROM {_FOUND} GROUP BY 1, 2""")
def fnd2(t):
    return findings.score(_found(t), {"state_flag": "High", "flag_negative": "Critical"})
