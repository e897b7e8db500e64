"""Aggregation and ranking jobs on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import EVENTS_NOW, ORDERS_NOW, bind, cents, half_up, money
from fleetgauge.functions.numbers import exact, row_count
from fleetgauge.functions.times import before
from fleetgauge.operators import aggregates as agg
from fleetgauge.operators import ranking


def _cents(column):
    return F.round(F.col(column) * 100).cast("bigint")


@bind("agg1_status_counts", f"""
SELECT o_custkey, count(*) AS total_runs, count(*) FILTER (WHERE o_orderstatus = 'O') AS successful, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS retry, {half_up("count(*) FILTER (WHERE o_orderstatus = 'F')", 'count(*)', 2, 100)} AS failure_ratio_pct FROM orders GROUP BY 1""")
def agg1(t):
    return agg.status_counts(t.orders, ["o_custkey"], "o_orderstatus", {"successful": "O", "failed": "F", "retry": "P"}, "failed")


@bind("agg2_age_buckets", f"""
SELECT user_id, event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS last_7d, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS day_8_to_14,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17') AS day_15_to_21, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS day_22_plus, count(*) AS total,
  CASE WHEN count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') > 4 THEN 1 ELSE 0 END AS flag_excessive FROM events GROUP BY 1, 2""")
def agg2(t):
    return agg.age_buckets(t.events, ["user_id", "event_type"], "ts", EVENTS_NOW, (7, 14, 21), 4)


@bind("agg3_total_row", f"""
SELECT 'INSTANCE_TOTAL' AS label, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tasks, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS total,
  CAST(sum({cents('l_tax')}) AS BIGINT) AS signal, CAST(sum({cents('l_extendedprice')} - {cents('l_tax')}) AS BIGINT) AS resource, max({cents('l_extendedprice')}) AS longest,
  {half_up(f"sum({cents('l_extendedprice')})", 'sum(CAST(l_quantity AS BIGINT))')} AS mean FROM lineitem""")
def agg3(t):
    return agg.total_row(t.lineitem, F.col("l_quantity").cast("bigint"), _cents("l_extendedprice"), _cents("l_tax"), _cents("l_extendedprice"))


@bind("agg4_with_total", f"""
SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(sum({money('value')}) AS DOUBLE) AS value FROM events GROUP BY 1
UNION ALL SELECT NULL, count(*), CAST(sum({money('value')}) AS DOUBLE) FROM events""")
def agg4(t):
    return agg.with_total(t.events.withColumn("day", F.to_date("ts")), ["day"], {"value": exact(F.col("value"))})


@bind("agg5_hourly", f"""
SELECT date_trunc('hour', ts) AS hour, count(*) AS entries, CAST(sum({cents('value')}) AS BIGINT) AS total, CAST(sum(runs) AS BIGINT) AS runs,
  {half_up(f"sum({cents('value')} // nullif(runs, 0))", "count(nullif(runs, 0))")} AS mean_per_run
FROM (SELECT *, user_id % 5 AS runs FROM events) WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 72 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 50""")
def agg5(t):
    return agg.hourly(t.events, "ts", EVENTS_NOW, _cents("value"), F.col("user_id") % 5, hours=72, newest=50)


@bind("agg6_category_impact", f"""
SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS total, {half_up('sum(c)', 'count(*)')} AS mean, count(DISTINCT l_suppkey) AS plans, count(DISTINCT l_partkey) AS queries
FROM (SELECT *, {cents('l_extendedprice')} - 5000000 AS c FROM lineitem) WHERE c > 0 GROUP BY 1""")
def agg6(t):
    return agg.category_impact(t.lineitem, "l_returnflag", _cents("l_extendedprice") - 5000000, "l_suppkey", "l_partkey")


@bind("agg6_merged_distinct", """
SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2""")
def agg6_merged(t):
    """Sets of two halves of the year, merged: as much as of the whole."""
    by = ["l_returnflag", "l_linestatus"]
    halves = [t.lineitem.filter(F.month("l_shipdate") <= 6), t.lineitem.filter(F.month("l_shipdate") > 6)]
    counts = []
    for column, out in (("l_partkey", "parts"), ("l_orderkey", "orders")):
        sets = agg.number_sets(halves[0], by, column).unionByName(agg.number_sets(halves[1], by, column))
        counts.append(agg.count_numbers(agg.merge_number_sets(sets, by), by, out))
    return counts[0].join(counts[1], by)


@bind("agg7_weighted_stats", f"""
SELECT l_partkey, CAST(sum(n) AS BIGINT) AS runs, {half_up('sum(c * n)', '100 * sum(n)')} AS weighted_mean, CAST(sum(c * n) AS DOUBLE) / 100 AS estimated_total, max(n) AS largest,
  CASE WHEN max(n) >= 50 THEN 1 ELSE 0 END AS flag_large FROM (SELECT l_partkey, {cents('l_extendedprice')} AS c, CAST(l_quantity AS BIGINT) AS n FROM lineitem) WHERE c > 0 GROUP BY 1""")
def agg7(t):
    return agg.weighted_stats(t.lineitem, ["l_partkey"], F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_quantity").cast("bigint"), 50)


@bind("agg8_variant_spread", f"""
SELECT l_partkey, count(DISTINCT l_suppkey) AS variants, min(c) AS best, max(c) AS worst, {half_up('max(c)', 'min(c)', 4)} AS worst_to_best
FROM (SELECT l_partkey, l_suppkey, {cents('l_extendedprice')} AS c FROM lineitem WHERE l_shipdate >= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 400 DAY) GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def agg8(t):
    return agg.variant_spread(t.lineitem, ["l_partkey"], "l_suppkey", _cents("l_extendedprice"), "l_shipdate", ORDERS_NOW, 400)


@bind("agg9_repeated_small", f"""
SELECT user_id, event_type, count(*) AS events, min(v) AS smallest, max(v) AS largest, min(ts) AS first_event, max(ts) AS last_event, {half_up('sum(v)', 'count(*)')} AS mean,
  CASE WHEN count(*) > 5 AND max(v) < 200 THEN 1 ELSE 0 END AS flag_repeated_small FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY 1, 2 HAVING count(*) > 1""")
def agg9(t):
    return agg.repeated_small(t.events, ["user_id", "event_type"], F.floor("value"), "ts", small=200)


@bind("agg10_size_rollup", """
SELECT l_orderkey, CAST(coalesce(sum(q) FILTER (WHERE i < 2), 0) AS BIGINT) AS row_count, CAST(8 * sum(p) AS BIGINT) AS total_kb, CAST(8 * coalesce(sum(q) FILTER (WHERE i < 2), 0) AS BIGINT) AS data_kb,
  CAST(8 * (sum(p) - coalesce(sum(q) FILTER (WHERE i < 2), 0)) AS BIGINT) AS index_kb, max(CASE i WHEN 0 THEN 'HEAP' WHEN 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END) AS structure
FROM (SELECT l_orderkey, l_linenumber - 1 AS i, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) * 3 AS p FROM lineitem) GROUP BY 1""")
def agg10(t):
    q = F.col("l_quantity").cast("bigint")
    return agg.size_rollup(t.lineitem, ["l_orderkey"], F.col("l_linenumber") - 1, q, q * 3, q)


@bind("agg11_free_space", f"""
WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(CAST(floor(o_totalprice) AS BIGINT)) AS s, sum(o_custkey * 50) AS f FROM orders GROUP BY 1),
     g AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS s, sum(CAST(l_quantity AS BIGINT) * 1000) AS u FROM lineitem GROUP BY 1)
SELECT month, CAST(d.s AS BIGINT) AS data_size, CAST(d.f AS BIGINT) AS data_free, CAST(g.s AS BIGINT) AS log_size, CAST(g.u AS BIGINT) AS log_used, CAST(d.s - d.f AS BIGINT) AS data_used,
  CAST(g.s - g.u AS BIGINT) AS log_free, CAST(d.s + g.s AS BIGINT) AS total_size, CAST(d.f + g.s - g.u AS BIGINT) AS total_free, {half_up('d.f + g.s - g.u', 'd.s + g.s', 2, 100)} AS free_pct,
  CASE WHEN d.f + g.s - g.u < 0 THEN 'ERROR' WHEN (d.f + g.s - g.u) * 10 < d.s + g.s THEN 'LOW_FREE_SPACE' WHEN (d.f + g.s - g.u) * 5 < d.s + g.s THEN 'WATCH' ELSE 'OK' END AS space_flag
FROM d JOIN g USING (month)""")
def agg11(t):
    month = lambda c: F.trunc(F.to_date(c), "month").alias("month")
    data = t.orders.select(month("o_orderdate"), F.floor("o_totalprice").alias("size"), (F.col("o_custkey") * 50).alias("free"))
    log = t.lineitem.select(month("l_shipdate"), F.floor("l_extendedprice").alias("size"), (F.col("l_quantity").cast("bigint") * 1000).alias("used"))
    return agg.free_space(data, log, ["month"])


@bind("agg12_cache_mix", f"""
SELECT p_brand, count(*) AS entries, count(*) FILTER (WHERE u = 1 AND p_type = 'PROMO') AS single_use, count(*) FILTER (WHERE u > 1) AS multi_use, count(*) FILTER (WHERE p_type = 'PROMO') AS adhoc,
  CAST(sum(p_size) AS BIGINT) AS total_size, CAST(coalesce(sum(p_size) FILTER (WHERE u = 1 AND p_type = 'PROMO'), 0) AS BIGINT) AS single_use_size,
  {half_up("count(*) FILTER (WHERE u = 1 AND p_type = 'PROMO')", 'count(*)', 2, 100)} AS single_use_pct FROM (SELECT *, p_partkey % 4 AS u FROM part) GROUP BY 1""")
def agg12(t):
    return agg.cache_mix(t.part, "p_type", F.col("p_partkey") % 4, F.col("p_size"), "PROMO", ["p_brand"]).totals


@bind("agg12_cache_by_type", f"""
SELECT p_type, count(*) AS entries, CAST(sum(p_partkey % 4) AS BIGINT) AS uses, CAST(sum(p_size) AS BIGINT) AS total_size, {half_up('sum(p_size)', 'count(*)')} AS mean_size FROM part GROUP BY 1""")
def agg12b(t):
    return agg.cache_mix(t.part, "p_type", F.col("p_partkey") % 4, F.col("p_size"), "PROMO").by_type


@bind("agg13_segment_health", f"""
SELECT l_orderkey, count(*) AS segments, count(*) FILTER (WHERE l_linestatus = 'O') AS active, count(*) FILTER (WHERE l_linestatus <> 'O') AS inactive, min(l_quantity) AS min_size, max(l_quantity) AS max_size,
  CAST(sum(l_quantity) AS DOUBLE) AS total_size, {half_up('sum(CAST(l_quantity AS BIGINT))', 'count(*)', 4)} AS mean_size,
  CASE WHEN count(*) > 7 THEN 'EXCESSIVE_VLF' WHEN min(l_quantity) < 3 AND count(*) > 4 THEN 'MANY_SMALL_VLF' ELSE '' END AS segment_flag FROM lineitem GROUP BY 1""")
def agg13(t):
    return agg.segment_health(t.lineitem, ["l_orderkey"], F.col("l_quantity"), F.col("l_linestatus") == "O", 7, 3, 4)


@bind("agg14_count_by", f"""
SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) AS rows, CAST(sum({money('o_totalprice')}) AS DOUBLE) AS total, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2, 3""")
def agg14(t):
    return agg.count_by(t.orders.withColumn("y", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "y"],
                        {"total": exact(F.col("o_totalprice"))}, {"largest": F.col("o_totalprice")})


@bind("agg15_uniformity", f"""
SELECT s_suppkey, s_nationkey, CASE WHEN min(s_acctbal) OVER w = max(s_acctbal) OVER w THEN 'Y' ELSE 'N' END AS equal_sizes,
  CASE WHEN min(s_suppkey % 2) OVER w = max(s_suppkey % 2) OVER w THEN 'Y' ELSE 'N' END AS equal_growth,
  CASE WHEN count(*) OVER w <= 1 THEN 'N/A' WHEN 2 * {cents('s_acctbal')} * count(*) OVER w < sum({cents('s_acctbal')}) OVER w THEN 'Y' ELSE 'N' END AS undersized
FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def agg15(t):
    rows = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 2).alias("growth"))
    return agg.uniformity(rows, ["s_nationkey"], "s_acctbal", "growth").drop("s_acctbal", "growth")


@bind("agg16_window_counts", f"""
SELECT metric, items, CASE WHEN issue AND items > 0 THEN 1 ELSE 0 END AS flag_issue FROM (
  SELECT 'FailedItems_Last7Days' AS metric, count(*) AS items, true AS issue FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24'
  UNION ALL SELECT 'UnsentItems_Current', count(*), true FROM events WHERE value < 0
  UNION ALL SELECT 'SentItems_Last24Hours', count(*), false FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30')""")
def agg16(t):
    kind, ts = F.col("event_type"), F.col("ts")
    return agg.window_counts(t.events, {
        "FailedItems_Last7Days": ((kind == "error") & (ts >= before(EVENTS_NOW, days=7)), True),
        "UnsentItems_Current": (F.col("value") < 0, True),
        "SentItems_Last24Hours": ((kind == "view") & (ts >= before(EVENTS_NOW, hours=24)), False)})


@bind("agg17_utilisation", f"""
SELECT s_nationkey, count(*) AS units, CAST(sum(s_suppkey) AS BIGINT) AS active, cap AS capacity, {half_up('sum(s_suppkey)', 'cap', 1, 100)} AS used_pct,
  CASE WHEN sum(s_suppkey) * 10 > cap * 9 THEN 1 ELSE 0 END AS flag_exhaustion FROM supplier, (SELECT max(s_suppkey) * 3 AS cap FROM supplier) GROUP BY s_nationkey, cap""")
def agg17(t):
    cap = t.supplier.agg((F.max("s_suppkey") * 3).alias("capacity")).scalar()
    per = agg.count_by(t.supplier, ["s_nationkey"]).select("s_nationkey", cap.alias("capacity"))
    return agg.utilisation(t.supplier, F.col("s_suppkey"), per, ["s_nationkey"])


@bind("agg17_utilisation_total", f"""
SELECT count(*) AS units, CAST(sum(s_suppkey) AS BIGINT) AS active, cap AS capacity, {half_up('sum(s_suppkey)', 'cap', 1, 100)} AS used_pct,
  CASE WHEN sum(s_suppkey) * 10 > cap * 9 THEN 1 ELSE 0 END AS flag_exhaustion FROM supplier, (SELECT max(c_custkey) * 5 AS cap FROM customer) GROUP BY cap""")
def agg17b(t):
    return agg.utilisation(t.supplier, F.col("s_suppkey"), t.customer.agg((F.max("c_custkey") * 5).alias("capacity")))


_LINE = "l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _line_order():
    return [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@bind("top1_top_k", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY {_LINE} LIMIT 20")
def top1(t):
    return ranking.top_k(t.lineitem, _line_order(), 20).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@bind("top2_top_k_per", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, {cents('l_extendedprice')} * CAST(l_quantity AS BIGINT) AS total_cost, rn::INTEGER AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {cents('l_extendedprice')} * CAST(l_quantity AS BIGINT) DESC, {_LINE.replace('l_extendedprice DESC, ', '')}) AS rn FROM lineitem) WHERE rn <= 5""")
def top2(t):
    rows = t.lineitem.withColumn("total_cost", _cents("l_extendedprice") * F.col("l_quantity").cast("bigint"))
    order = [F.desc("total_cost"), *_line_order()[1:]]
    return ranking.top_k_per(rows, ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "total_cost", "rn")


@bind("top3_severity_sort", """
SELECT o_orderkey, o_orderstatus, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 50 END AS severity_rank FROM orders ORDER BY severity_rank, o_totalprice DESC, o_orderkey""")
def top3(t):
    return ranking.severity_sort(t.orders, "o_orderstatus", {"F": 1, "P": 2}, [F.desc("o_totalprice"), F.col("o_orderkey")]).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "severity_rank")


@bind("top4_net_top", f"""
SELECT l_suppkey, user_net, internal_net, user_net + internal_net AS total_net, {half_up('user_net + internal_net', '128')} AS total_net_mb FROM (
  SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT) - 3 * l_linenumber) AS BIGINT) AS user_net, CAST(sum(l_linenumber * 4 - 20) AS BIGINT) AS internal_net FROM lineitem GROUP BY 1)
WHERE user_net + internal_net > 0 ORDER BY total_net DESC, l_suppkey LIMIT 20""")
def top4(t):
    n = F.col("l_linenumber")
    use = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("ua"), F.sum(n * 3).alias("ud"), F.sum(n * 4).alias("ia"), (row_count() * 20).alias("id"))
    return ranking.net_top(use, ["l_suppkey"], ("ua", "ud"), ("ia", "id")).drop("ua", "ud", "ia", "id")
