"""Ordered histories on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import EVENTS_NOW, bind, cents, half_up
from fleetgauge.operators import windows
from fleetgauge.operators.aggregates import count_by

EV = ["ts", "event_id"]

_GAPS = """(SELECT *, lag(ts) OVER w AS previous, date_diff('minute', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _gaps(t):
    return windows.gaps(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", tie=["event_id"])


@bind("win1_gaps", f"SELECT event_id, user_id, ts, previous, gap FROM {_GAPS}")
def win1(t):
    return _gaps(t)


@bind("win1_gaps_to_start", """
SELECT event_id, event_type, start, ts, lag(ts) OVER w AS previous, date_diff('hour', lag(ts) OVER w, start) AS gap
FROM (SELECT *, ts - INTERVAL 90 SECOND AS start FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def win1b(t):
    rows = t.events.select("event_id", "event_type", (F.col("ts") - F.expr("INTERVAL 90 SECONDS")).alias("start"), "ts")
    return windows.gaps(rows, ["event_type"], "ts", start="start", tie=["event_id"], unit="hour")


@bind("win2_gap_stats", f"""
SELECT user_id, count(*) AS events, {half_up('sum(gap)', 'count(gap)', 1)} AS mean_gap, max(gap) AS max_gap, max(ts) AS last_event, count(*) FILTER (WHERE gap > 60) AS gaps_over_limit
FROM {_GAPS} WHERE gap IS NOT NULL GROUP BY 1""")
def win2(t):
    return windows.gap_stats(_gaps(t), ["user_id"], "ts").drop("_sum", "_n")


@bind("win2_gap_stats_with_first", f"""
SELECT user_id, count(*) AS events, {half_up('sum(gap)', 'count(gap)', 1)} AS mean_gap, max(gap) AS max_gap, max(ts) AS last_event, count(*) FILTER (WHERE gap > 300) AS gaps_over_limit
FROM {_GAPS} GROUP BY 1""")
def win2b(t):
    return windows.gap_stats(_gaps(t), ["user_id"], "ts", count_first=True, limit=300).drop("_sum", "_n")


_CHAIN = """(SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'signup' THEN 'D' WHEN 'purchase' THEN 'I' WHEN 'view' THEN 'L' ELSE 'X' END AS kind,
  event_id AS first_mark, event_id + 1 AS last_mark, event_id % 50 AS base, CASE WHEN value < 40 THEN 'FULL' ELSE 'SIMPLE' END AS model, value > 90 AS copy_only FROM events)"""


def chain_rows(t):
    kind = F.when(F.col("event_type") == "signup", "D").when(F.col("event_type") == "purchase", "I").when(F.col("event_type") == "view", "L").otherwise("X")
    return t.events.select("event_id", "user_id", "ts", kind.alias("kind"), F.col("event_id").alias("first_mark"), (F.col("event_id") + 1).alias("last_mark"),
                           (F.col("event_id") % 50).alias("base"), F.when(F.col("value") < 40, "FULL").otherwise("SIMPLE").alias("model"), (F.col("value") > 90).alias("copy_only"))


_AUDIT = f"""
WITH h AS (SELECT *, lag(last_mark) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) AS p_last, lag(model) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p_model,
   max(CASE WHEN kind = 'D' AND NOT copy_only THEN last_mark END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_base FROM {_CHAIN})
SELECT event_id, user_id, ts, kind, anomaly, note FROM (
  SELECT *, 'SEQUENCE_GAP' AS anomaly, 'starts at ' || first_mark || ', previous log ended at ' || p_last AS note FROM h WHERE kind = 'L' AND first_mark <> p_last
  UNION ALL SELECT *, 'ATTRIBUTE_CHANGE', 'was ' || p_model || ', now ' || model FROM h WHERE model <> p_model
  UNION ALL SELECT *, 'BASE_MISMATCH', 'names base ' || base || ', last full ended at ' || p_base FROM h WHERE kind = 'I' AND base <> p_base
  UNION ALL SELECT *, 'COPY_ONLY_FULL', 'does not reset the base' FROM h WHERE kind = 'D' AND copy_only)"""


@bind("win3_chain_audit", _AUDIT)
def win3(t):
    out = windows.chain_audit(chain_rows(t), ["user_id"], "kind", "ts", "first_mark", "last_mark", "base", "model", F.col("copy_only"), ["event_id"])
    return out.select("event_id", "user_id", "ts", "kind", "anomaly", "note")


@bind("win4_gap_list", f"SELECT user_id, previous AS previous_event, ts AS this_event, gap, {half_up('gap', '60', 1)} AS gap_hours FROM {_GAPS} WHERE gap > 600")
def win4(t):
    return windows.gap_list(_gaps(t), ["user_id"], "ts", 600)


@bind("win5_latest", """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND (p.o_orderdate > o.o_orderdate OR (p.o_orderdate = o.o_orderdate AND p.o_orderkey > o.o_orderkey)))""")
def win5(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return windows.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@bind("win6_latest_ties", """
SELECT l_partkey, l_orderkey, l_shipdate, l_suppkey FROM lineitem JOIN (SELECT l_partkey AS k, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON k = l_partkey AND m = l_shipdate""")
def win6(t):
    return windows.latest_ties(t.lineitem.select("l_partkey", "l_orderkey", "l_shipdate", "l_suppkey"), ["l_partkey"], "l_shipdate")


@bind("win7_last_n_stats", f"""
SELECT o_custkey, count(*) AS runs, {half_up(f"sum({cents('o_totalprice')})", '100 * count(*)')} AS mean_size, {half_up('sum(o_orderkey % 600)', 'count(*)', 1)} AS mean_sec,
  {half_up(f"sum({cents('o_totalprice')})", '100 * sum(o_orderkey % 600)')} AS throughput, min(o_orderdate) AS oldest, max(o_orderdate) AS newest
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 10 GROUP BY 1""")
def win7(t):
    return windows.last_n_stats(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderdate", F.col("o_totalprice"), F.col("o_orderkey") % 600)


_NEWEST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@bind("win8_regressions", f"""
SELECT l_partkey, a.p AS recent, b.p AS earlier, a.l_suppkey, {half_up('CAST(round(a.p * 100) AS BIGINT)', 'CAST(round(b.p * 100) AS BIGINT)', 4)} AS times_slower FROM
  (SELECT l_partkey, l_suppkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(c + ' DESC' for c in _NEWEST)}) AS n FROM lineitem) a
  JOIN (SELECT l_partkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(c + ' DESC' for c in _NEWEST)}) AS n FROM lineitem) b USING (l_partkey)
WHERE a.n = 1 AND b.n = 2 AND a.p > 2 * b.p AND b.p > 0""")
def win8(t):
    return windows.regressions(t.lineitem, ["l_partkey"], [F.desc(c) for c in _NEWEST], "l_extendedprice", 2, ["l_suppkey"])


@bind("win9_share", f"""
SELECT event_type, c AS total, {half_up('c', '(SELECT sum(' + cents('value') + ') FROM events)', 2, 100)} AS share_pct FROM (SELECT event_type, CAST(sum({cents('value')}) AS BIGINT) AS c FROM events GROUP BY 1)""")
def win9(t):
    return windows.share(count_by(t.events, ["event_type"], {"total": F.round(F.col("value") * 100).cast("bigint")}).drop("rows"), "total")


@bind("win9_share_in_group", f"""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, {half_up('CAST(l_quantity AS BIGINT)', 'sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey, l_returnflag)', 2, 100)} AS share_pct FROM lineitem""")
def win9b(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return windows.share(rows, "q", ["l_suppkey", "l_returnflag"]).drop("l_suppkey", "l_returnflag")


@bind("win10_recurrence", """
SELECT e.event_id, n AS occurrences, CASE WHEN n > 1 THEN 1 ELSE 0 END AS flag_recurring FROM events e JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) g USING (user_id, event_type)""")
def win10(t):
    return windows.recurrence(t.events, ["user_id", "event_type"]).select("event_id", "occurrences", "flag_recurring")


@bind("win11_peer_deviation", f"""
SELECT s_suppkey, n AS peers, {half_up('total', '100 * n')} AS peer_mean, {half_up(f"{cents('s_acctbal')} * n", 'total', 4)} AS ratio_to_mean,
  CASE WHEN n > 1 AND abs({cents('s_acctbal')} * n - total) * 4 > abs(total) THEN 1 ELSE 0 END AS flag_deviation
FROM supplier JOIN (SELECT s_nationkey, count(*) AS n, CAST(sum({cents('s_acctbal')}) AS BIGINT) AS total FROM supplier GROUP BY 1) USING (s_nationkey)""")
def win11(t):
    return windows.peer_deviation(t.supplier, ["s_nationkey"], "s_acctbal").select("s_suppkey", "peers", "peer_mean", "ratio_to_mean", "flag_deviation")


@bind("win11_peer_factor", f"""
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN CAST(l_quantity AS BIGINT) * n > 2 * total AND total > 0 THEN 1 ELSE 0 END AS flag_deviation FROM lineitem
JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1) USING (l_orderkey)""")
def win11b(t):
    return windows.peer_deviation(t.lineitem, ["l_orderkey"], "l_quantity", factor=2).select("l_orderkey", "l_linenumber", "l_quantity", "flag_deviation")


@bind("win12_status_at_last", """
SELECT o_custkey, m AS last_run, max(o_orderstatus) AS last_status FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_orderdate GROUP BY 1, 2""")
def win12(t):
    return windows.status_at_last(t.orders, ["o_custkey"], "o_orderdate", "o_orderstatus")


@bind("win13_exposure", f"""
WITH u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN 'SIMPLE' ELSE 'FULL' END AS model FROM events),
  g AS (SELECT user_id, ts, date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-26'),
  s AS (SELECT user_id, count(*) AS events, sum(gap) AS total, max(gap) AS max_gap, max(ts) AS last_event, count(*) FILTER (WHERE gap > 60) AS gaps_over_limit FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT user_id, model, s.events, {half_up('total', 's.events', 1)} AS mean_gap, max_gap, last_event, gaps_over_limit, date_diff('minute', last_event, TIMESTAMP '{EVENTS_NOW}') AS minutes_since_last,
  CASE WHEN model = 'FULL' AND max_gap > 60 THEN 1 ELSE 0 END AS flag_missed_window,
  CASE WHEN model = 'FULL' AND (last_event IS NULL OR date_diff('minute', last_event, TIMESTAMP '{EVENTS_NOW}') > total / s.events) THEN 1 ELSE 0 END AS flag_exposed,
  CASE WHEN model = 'FULL' AND last_event IS NULL THEN 1 ELSE 0 END AS flag_no_event FROM u LEFT JOIN s USING (user_id)""")
def win13(t):
    users = t.events.select("user_id").distinct().withColumn("model", F.when(F.col("user_id") % 4 == 0, "SIMPLE").otherwise("FULL"))
    views = t.events.filter((F.col("event_type") == "view") & (F.col("ts") >= windows.instant("2024-01-26 00:00:00"))).select("event_id", "user_id", "ts")
    stats = windows.gap_stats(windows.gaps(views, ["user_id"], "ts", tie=["event_id"]), ["user_id"], "ts")
    return windows.exposure(users, stats, ["user_id"], EVENTS_NOW, "model")


@bind("win14_counter_delta", """
WITH r AS (SELECT user_id, ts, event_id, event_id // 4000 AS boot, (event_id % 4000) * 10 + CAST(floor(value / 20) AS BIGINT) AS total FROM events)
SELECT event_id, total, CASE WHEN p IS NULL THEN NULL WHEN total < p OR boot <> pb THEN total ELSE total - p END AS delta, CASE WHEN total < p OR boot <> pb THEN 1 ELSE 0 END AS flag_restart
FROM (SELECT *, lag(total) OVER w AS p, lag(boot) OVER w AS pb FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def win14(t):
    rows = t.events.select("event_id", "user_id", "ts", F.floor(F.col("event_id") / 4000).alias("boot"),
                           ((F.col("event_id") % 4000) * 10 + F.floor(F.col("value") / 20)).alias("total"))
    return windows.counter_delta(rows, ["user_id"], "ts", {"delta": "total"}, "boot", ["event_id"]).select("event_id", "total", "delta", "flag_restart")
