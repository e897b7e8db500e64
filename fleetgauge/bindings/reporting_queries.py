"""Date, number, text, list and setting reports on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import EVENTS_NOW, bind, cents, half_up
from fleetgauge.functions.numbers import exact
from fleetgauge.operators import reporting as rep
from fleetgauge.operators.aggregates import with_total


@bind("dat1_age_report", f"""
SELECT user_id, max(ts) AS last_event, date_diff('hour', max(ts), TIMESTAMP '{EVENTS_NOW}') AS age, CASE WHEN date_diff('hour', max(ts), TIMESTAMP '{EVENTS_NOW}') <= 6 THEN 'FRESH'
  WHEN date_diff('hour', max(ts), TIMESTAMP '{EVENTS_NOW}') <= 24 THEN 'DAY' ELSE 'OLD' END AS age_band FROM events GROUP BY 1""")
def dat1(t):
    return rep.age_report(t.events, ["user_id"], "ts", EVENTS_NOW, "hour", [(6, "FRESH"), (24, "DAY")], "OLD")


_PACK = """(SELECT o_orderkey, o_custkey, o_orderdate + to_seconds(o_orderkey % 86400) AS run_at, (o_orderkey % 90000) AS sec FROM orders)"""


def _packed(t):
    sec = F.col("o_orderkey") % 86400
    hms = lambda s: F.floor(s / 3600) * 10000 + F.floor(s % 3600 / 60) * 100 + s % 60
    day = F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
    return t.orders.select("o_orderkey", "o_custkey", day.alias("run_date"), hms(sec).alias("run_time"), hms(F.col("o_orderkey") % 90000).alias("run_duration"))


@bind("dat3_packed_runs", f"SELECT o_orderkey, run_at, sec AS duration_sec FROM {_PACK}")
def dat3(t):
    return rep.packed_runs(_packed(t), ["o_custkey"], "run_date", "run_time", "run_duration").runs.select("o_orderkey", "run_at", "duration_sec")


@bind("dat3_packed_runs_per_day", f"SELECT o_custkey, CAST(run_at AS DATE) AS run_day, count(*) AS runs, CAST(sum(sec) AS BIGINT) AS seconds FROM {_PACK} GROUP BY 1, 2")
def dat3d(t):
    return rep.packed_runs(_packed(t), ["o_custkey"], "run_date", "run_time", "run_duration").per_day


@bind("num1_ratio_report", f"""
SELECT l_suppkey, CAST(sum(n) AS DOUBLE) / 100 AS num, CAST(sum(d) AS BIGINT) AS den, coalesce({half_up('sum(n)', '100 * sum(d)')}, 0) AS quotient,
  coalesce({half_up('sum(n)', '100 * sum(d)', 2, 100)}, 0) AS pct
FROM (SELECT l_suppkey, {cents('l_extendedprice')} AS n, CAST(l_quantity AS BIGINT) * (l_suppkey % 7) AS d FROM lineitem) GROUP BY 1""")
def num1(t):
    return rep.ratio_report(t.lineitem, ["l_suppkey"], exact(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint") * (F.col("l_suppkey") % 7), zero=0)


_FILES = """(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 500 AS size, CASE WHEN l_returnflag = 'N' THEN -1 WHEN l_tax > 0.07 THEN 268435456 ELSE 20000 END AS mx,
  CASE WHEN l_linestatus = 'F' THEN 10 ELSE CAST(l_quantity AS BIGINT) * 700 END AS growth, l_linestatus = 'F' AS pct, l_linenumber > 1 AS is_data FROM lineitem)"""


def _files(t):
    q = F.col("l_quantity").cast("bigint")
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", (q * 500).alias("size"),
        F.when(F.col("l_returnflag") == "N", -1).when(F.col("l_tax") > 0.07, 268435456).otherwise(20000).alias("mx"),
        F.when(F.col("l_linestatus") == "F", 10).otherwise(q * 700).alias("growth"), (F.col("l_linestatus") == "F").alias("pct"), (F.col("l_linenumber") > 1).alias("is_data"))
    return rep.file_inventory(rows, "size", "mx", "growth", F.col("pct"), F.col("is_data"), ["l_orderkey"])


@bind("num2_file_inventory", f"""
SELECT l_orderkey, l_linenumber, size // 128 AS size_mb, CASE WHEN mx IN (-1, 268435456) THEN -1 ELSE mx // 128 END::BIGINT AS max_size_mb,
  CASE WHEN pct THEN growth || '%' ELSE (growth // 128) || ' MB' END AS growth_text FROM {_FILES}""")
def num2(t):
    return _files(t).files.select("l_orderkey", "l_linenumber", "size_mb", "max_size_mb", "growth_text")


@bind("num2_file_totals", f"""
SELECT l_orderkey, count(*) AS files, CAST(sum(size // 128) AS BIGINT) AS size_mb, count(*) FILTER (WHERE mx IN (-1, 268435456)) AS flag_unlimited, count(*) FILTER (WHERE mx = 20000 AND size > 18000) AS flag_near_max,
  count(*) FILTER (WHERE NOT pct AND is_data AND growth > 0 AND growth // 128 < 128) AS flag_small_growth, count(*) FILTER (WHERE pct) AS flag_percent_growth FROM {_FILES} GROUP BY 1""")
def num2t(t):
    return _files(t).totals


_QUEUES = "(SELECT l_suppkey, CAST(l_quantity AS BIGINT) * 30000 AS q, CAST(round(l_discount * 100) AS BIGINT) * 7 AS r FROM lineitem)"


def _queues(t):
    return t.lineitem.select("l_suppkey", (F.col("l_quantity").cast("bigint") * 30000).alias("q"), (F.round(F.col("l_discount") * 100).cast("bigint") * 7).alias("r"))


@bind("num3_catch_up", f"""
SELECT l_suppkey, count(*) AS rows, max({half_up('q', 'r', 1)}) FILTER (WHERE r > 0) AS worst_sec, max(q) AS largest_queue, count(*) FILTER (WHERE r = 0 AND q > 0) AS stalled,
  CASE WHEN max(q) > 1499999 THEN 'QUEUE_HIGH' WHEN max(q) > 102400 THEN 'QUEUE_WARN' ELSE 'other' END AS queue_flag FROM {_QUEUES} GROUP BY 1""")
def num3(t):
    return rep.catch_up(_queues(t), ["l_suppkey"], F.col("q"), F.col("r"), 1499999, 102400)


@bind("num3_catch_up_whole", f"""
SELECT l_suppkey, count(*) AS rows, CAST(max(q // nullif(r, 0)) AS DOUBLE) AS worst_sec, max(q) AS largest_queue, count(*) FILTER (WHERE r = 0 AND q > 0) AS stalled,
  CASE WHEN max(q) > 1600000 THEN 'QUEUE_HIGH' WHEN bool_or(r = 0 AND q > 0) THEN 'ZERO_RATE' ELSE '' END AS queue_flag FROM {_QUEUES} GROUP BY 1""")
def num3w(t):
    return rep.catch_up(_queues(t), ["l_suppkey"], F.col("q"), F.col("r"), 1600000, whole=True)


@bind("num4_progress", f"""
SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS done, CAST(sum(l_linenumber * 20) AS BIGINT) AS total, coalesce({half_up('sum(CAST(l_quantity AS BIGINT))', 'sum(l_linenumber * 20)', 1, 100)}, 0) AS percent_done,
  CAST(sum(l_linenumber * 20) - sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS remaining FROM lineitem GROUP BY 1""")
def num4(t):
    return rep.progress(t.lineitem, ["l_orderkey"], F.col("l_quantity").cast("bigint"), F.col("l_linenumber") * 20)


@bind("str1_contention_census", f"""
SELECT l_linestatus, c AS page_class, count(*) AS waits, CAST(sum(w) AS BIGINT) AS wait_total, max(w) AS wait_max, CASE WHEN c <> 'DATA_OR_OTHER' THEN 1 ELSE 0 END AS flag_allocation_page FROM (
  SELECT l_linestatus, CAST(l_quantity AS BIGINT) AS w, CASE WHEN bad THEN 'DATA_OR_OTHER' WHEN page IN (1) OR (page > 1 AND (page - 1) % 8088 = 0) THEN 'PFS' WHEN page = 2 OR (page > 2 AND (page - 2) % 511232 = 0) THEN 'GAM'
    WHEN page = 3 OR (page > 3 AND (page - 3) % 511232 = 0) THEN 'SGAM' ELSE 'DATA_OR_OTHER' END AS c
  FROM (SELECT *, l_returnflag = 'N' AND l_linenumber = 7 AS bad, (l_suppkey % 4) + (CASE WHEN l_linenumber > 2 THEN 511232 ELSE 8088 END) * (l_linenumber % 3) AS page FROM lineitem)) GROUP BY ALL""")
def str1(t):
    n = F.col("l_linenumber")
    page = F.col("l_suppkey") % 4 + F.when(n > 2, 511232).otherwise(8088) * (n % 3)
    text = F.concat(F.lit("2:1:"), F.when((F.col("l_returnflag") == "N") & (n == 7), "x").otherwise(page.cast("string")))
    return rep.contention_census(t.lineitem.withColumn("resource", text), "resource", F.col("l_quantity").cast("bigint"), ["l_linestatus"])


@bind("str2_location_census", """
SELECT split_part(url, ':', 1) AS scheme, left(url, len(url) - strpos(reverse(url), '/') + 1) AS location, count(*) AS uses, count(DISTINCT url) AS paths FROM pages GROUP BY 1, 2""")
def str2(t):
    return rep.location_census(t.pages.withColumn("scheme", F.split_part("url", F.lit(":"), F.lit(1))), ["scheme"], "url")


@bind("str5_statement_census", """
SELECT lang, substr(text, 1 + (n_chars % 3)::INTEGER, CASE WHEN doc_id % 2 = 0 THEN 2000000 ELSE 1 + (n_chars % 50)::INTEGER END) AS statement, count(*) AS runs, CAST(sum(n_chars) AS BIGINT) AS total_cost, max(n_chars) AS max_cost FROM documents GROUP BY 1, 2""")
def str5(t):
    start = (F.col("n_chars") % 3) * 2
    end = F.when(F.col("doc_id") % 2 == 0, -1).otherwise(start + (F.col("n_chars") % 50) * 2)
    return rep.statement_census(t.documents, "text", start, end, F.col("n_chars"), ["lang"])


def _documents_xml(t):
    """One event document per event; clicks give broken text."""
    proc = lambda i: F.concat(F.lit(f'<process id="p{i}" object="obj'), (F.col("user_id") + i).cast("string"), F.lit('"/>'))
    body = F.concat(F.lit('<event name="'), F.col("event_type"), F.lit('" timestamp="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"><victim id="v'),
                    F.col("user_id").cast("string"), F.lit('"/>'), proc(1), F.when(F.col("event_id") % 2 == 0, proc(2)).otherwise(""), F.lit("</event>"))
    text = F.when(F.col("event_type") == "click", "<RingBuffer><event name=<br>").otherwise(F.concat(F.lit("<RingBuffer>"), body, body, F.lit("</RingBuffer>")))
    return t.events.select("event_id", text.alias("doc"))


@bind("str7_xml_events", """
SELECT event_id, event_type AS event_name, date_trunc('second', ts) AS event_time, 'v' || user_id AS victim, 'obj' || (user_id + 1) AS first_object, (CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS processes
FROM events, range(2) WHERE event_type <> 'click'""")
def str7(t):
    return rep.xml_events(_documents_xml(t), "doc", ["event_id"])


@bind("str7_xml_events_per_day", """
SELECT CAST(ts AS DATE) AS day, 2 * count(*) AS rows FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT NULL, 2 * count(*) FROM events WHERE event_type <> 'click'""")
def str7d(t):
    return with_total(rep.xml_events(_documents_xml(t), "doc").withColumn("day", F.to_date("event_time")), ["day"])


@bind("arr1_memberships", """
SELECT user_id, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles, count(DISTINCT event_type)::INTEGER AS role_count, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS flag_member
FROM events GROUP BY 1, 2""")
def arr1(t):
    return rep.memberships(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", "error")


@bind("arr2_route_list", """
SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ' -> ' ORDER BY l_linenumber, l_suppkey::VARCHAR) AS route, count(*)::INTEGER AS hops FROM lineitem GROUP BY 1""")
def arr2(t):
    return rep.route_list(t.lineitem, ["l_orderkey"], ["l_linenumber"], "l_suppkey")


@bind("cfg1_pivot_settings", """
SELECT doc_id % 50 AS server, max(quality) FILTER (WHERE toxic = 0) AS clean, max(quality) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1""")
def cfg1(t):
    rows = t.labels.select((F.col("doc_id") % 50).alias("server"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("name"), "quality")
    return rep.pivot_settings(rows, ["server"], "name", "quality", ["clean", "toxic"])


@bind("cfg2_overrides", """
SELECT c_custkey, c_nationkey, v AS value, d AS general, CASE WHEN v <> 0 AND v <> d THEN 1 ELSE 0 END AS flag_override FROM (SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal / 2000) AS BIGINT) AS v FROM customer)
LEFT JOIN (SELECT s_nationkey, CAST(floor(max(s_acctbal) / 2000) AS BIGINT) AS d FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def cfg2(t):
    local = t.customer.select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 2000).alias("value"))
    general = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.floor(F.max("s_acctbal") / 2000).alias("general"))
    return rep.overrides(local, general, ["c_nationkey"], "value", "general")


_SNAP = "(SELECT event_id, user_id, ts, event_type AS edition, CAST(floor(value / 25) AS BIGINT) AS level FROM events)"


def _drift(t):
    rows = t.events.select("event_id", "user_id", "ts", F.col("event_type").alias("edition"), F.floor(F.col("value") / 25).alias("level"))
    return rep.inventory_drift(rows, ["user_id"], "ts", ["edition", "level"], ["event_id"])


@bind("cfg3_inventory_latest", f"SELECT user_id, ts, edition, level FROM {_SNAP} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def cfg3(t):
    return _drift(t).latest


@bind("cfg3_inventory_changes", f"""
WITH x AS (SELECT *, lag(edition) OVER w AS pe, lag(level) OVER w AS pl FROM {_SNAP} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ts, 'edition' AS setting, edition AS value, pe AS previous FROM x WHERE pe IS NOT NULL AND edition <> pe
UNION ALL SELECT user_id, ts, 'level', level::VARCHAR, pl::VARCHAR FROM x WHERE pl IS NOT NULL AND level <> pl""")
def cfg3c(t):
    return _drift(t).changes


@bind("cfg3_fleet_outliers", f"""
WITH l AS (SELECT user_id, ts, edition, level::VARCHAR AS level FROM {_SNAP} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
 u AS (SELECT user_id, ts, 'edition' AS setting, edition AS value FROM l UNION ALL SELECT user_id, ts, 'level', level FROM l),
 m AS (SELECT setting, value FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY setting ORDER BY count(*) DESC, value) = 1)
SELECT u.user_id, u.ts, u.setting, u.value, m.value AS fleet_value FROM u JOIN m USING (setting) WHERE u.value <> m.value""")
def cfg3o(t):
    return _drift(t).outliers
