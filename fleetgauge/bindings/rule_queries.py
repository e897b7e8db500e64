"""Rule jobs on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import EVENTS_NOW, ORDERS_NOW, bind, cents, half_up
from fleetgauge.functions.numbers import exact, int_div, row_count
from fleetgauge.operators import rules
from fleetgauge.operators.aggregates import count_by


@bind("rul1_apply_rules", """
SELECT c_nationkey, count(*) AS rows, count(*) FILTER (WHERE o_totalprice > 400000) AS flag_large,
       count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS flag_urgent_failed,
       count(*) FILTER (WHERE nullif(o_orderstatus, 'P') = 'O') AS flag_done
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def rul1(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rules.apply_rules(rows, {
        "flag_large": F.col("o_totalprice") > 400000,
        "flag_urgent_failed": (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"),
        "flag_done": F.nullif(F.col("o_orderstatus"), F.lit("P")) == "O"}, ["c_nationkey"]).counts


@bind("rul1_flagged_rows", """
SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS flag_negative, CASE WHEN s_acctbal > 9000 THEN 1 ELSE 0 END AS flag_high
FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000""")
def rul1b(t):
    return rules.apply_rules(t.supplier.select("s_suppkey", "s_acctbal"),
                             {"flag_negative": F.col("s_acctbal") < 0, "flag_high": F.col("s_acctbal") > 9000}, []).flagged


@bind("rul2_band", f"""
SELECT o_orderpriority, CASE WHEN o_orderdate + INTERVAL 5 YEAR < TIMESTAMP '{ORDERS_NOW}' THEN 'EXPIRED'
   WHEN date_diff('day', TIMESTAMP '{ORDERS_NOW}', o_orderdate + INTERVAL 5 YEAR) < 30 THEN 'CRITICAL'
   WHEN date_diff('day', TIMESTAMP '{ORDERS_NOW}', o_orderdate + INTERVAL 5 YEAR) < 90 THEN 'HIGH'
   WHEN date_diff('day', TIMESTAMP '{ORDERS_NOW}', o_orderdate + INTERVAL 5 YEAR) < 180 THEN 'WARNING' ELSE 'OK' END AS band, count(*) AS rows
FROM orders GROUP BY ALL""")
def rul2(t):
    expiry = F.col("o_orderdate") + F.expr("INTERVAL 5 YEAR")
    return rules.band_census(t.orders, rules.expiry_ladder(expiry, ORDERS_NOW), "OK", ["o_orderpriority"])


@bind("rul2_band_prices", """
SELECT p_type, CASE WHEN p_retailprice < 950 THEN 'OK' WHEN p_retailprice < 1000 THEN 'Moderate' WHEN p_retailprice < 1050 THEN 'High' ELSE 'Critical' END AS band,
       count(*) AS rows FROM part GROUP BY ALL""")
def rul2b(t):
    p = F.col("p_retailprice")
    return rules.band_census(t.part, [(p < 950, "OK"), (p < 1000, "Moderate"), (p < 1050, "High")], "Critical", ["p_type"])


@bind("rul3_class_threshold", f"""
SELECT l_suppkey, l_returnflag, latency, lim AS class_limit, CASE WHEN latency > lim THEN 1 ELSE 0 END AS flag_over_limit FROM (
  SELECT l_suppkey, l_returnflag, CAST(sum({cents('l_extendedprice')}) // (100 * count(*)) AS BIGINT) AS latency,
         CASE l_returnflag WHEN 'A' THEN 38000 WHEN 'R' THEN 39000 END AS lim FROM lineitem GROUP BY 1, 2)""")
def rul3(t):
    lat = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(
        int_div(F.sum(exact(F.col("l_extendedprice"))) * 100, row_count() * 100).alias("latency"))
    return rules.class_threshold(lat, "l_returnflag", {"A": 38000, "R": 39000}, F.col("latency"))


@bind("rul4_code_census", """
SELECT o_orderstatus, o_orderpriority, count(*) AS rows, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Succeeded' ELSE o_orderstatus END AS label,
       CASE o_orderstatus WHEN 'F' THEN 'look at the last message' ELSE '' END AS advice
FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def rul4(t):
    return rules.code_census(t.orders, "o_orderstatus", {"F": "Failed", "O": "Succeeded"}, ["o_orderpriority"],
                             advice={"F": "look at the last message"})


@bind("rul5_categorise", """
SELECT CASE WHEN p_type IN ('PROMO') OR p_size * 10 > 480 THEN 'CPU' WHEN p_name LIKE 'small_%' OR p_name LIKE '%_ring' THEN 'IO'
   WHEN p_name LIKE 'blue_%' THEN 'LOCK' WHEN p_type = 'PROMO' THEN 'UNREACHED' ELSE 'OTHER' END AS category, p_brand, count(*) AS rows,
   CAST(sum(p_size) AS BIGINT) AS total_size
FROM part GROUP BY ALL""")
def rul5(t):
    n = F.col("p_name")
    ladder = [(F.col("p_type").isin("PROMO") | (F.col("p_size") * 10 > 480), "CPU"), (n.like("small_%") | n.like("%_ring"), "IO"),
              (n.like("blue_%"), "LOCK"), (F.col("p_type") == "PROMO", "UNREACHED")]
    return rules.category_census(t.part, ladder, by=["p_brand"], measures={"total_size": F.sum("p_size")})


@bind("rul6_exclude", """
SELECT p_type, p_name, count(*) AS rows FROM part WHERE p_type NOT IN ('PROMO', 'LARGE') AND NOT (p_type LIKE 'S_ALL' OR p_type LIKE 'ECON%') GROUP BY ALL""")
def rul6(t):
    return count_by(rules.exclude(t.part, "p_type", ["PROMO", "LARGE"], ["S_ALL", "ECON%"]), ["p_type", "p_name"])


@bind("rul7_flag_combinations", """
SELECT c_nationkey, trim((CASE WHEN c_acctbal < 0 THEN 'NEGATIVE ' ELSE '' END) || (CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING ' ELSE '' END)
   || (CASE WHEN c_acctbal > 8000 THEN 'RICH ' ELSE '' END)) AS flags, count(*) AS rows FROM customer GROUP BY ALL""")
def rul7(t):
    return rules.flag_combinations(t.customer, [(F.col("c_acctbal") < 0, "NEGATIVE"), (F.col("c_mktsegment") == "BUILDING", "BUILDING"),
                                                (F.col("c_acctbal") > 8000, "RICH")], ["c_nationkey"])


@bind("rul8_bit_census", """
SELECT l_orderkey, bit, count(*) AS rows FROM lineitem JOIN (VALUES (1, 'Email'), (2, 'Pager'), (4, 'NetSend')) b(m, bit) ON (l_linenumber & m) > 0 GROUP BY 1, 2""")
def rul8(t):
    return rules.bit_census(t.lineitem, "l_linenumber", rules.NOTIFY_BITS, ["l_orderkey"])


@bind("rul9_pending_change", "SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def rul9(t):
    return rules.pending_change(t.labels.select("doc_id", "quality", "toxic"), "quality", "toxic")


@bind("rul10_grant_flags", f"""
SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) FILTER (WHERE gt IS NULL) AS flag_pending,
   count(*) FILTER (WHERE gt IS NOT NULL AND u > 0 AND g > 2 * u) AS flag_excessive, count(*) FILTER (WHERE gt IS NOT NULL AND g > 0 AND u < g / 2) AS flag_underused
FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS g, CAST(l_linenumber AS BIGINT) * 4 AS u, CASE WHEN l_tax > 0 THEN l_shipdate END AS gt FROM lineitem) GROUP BY 1, 2""")
def rul10(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("granted"),
                             (F.col("l_linenumber") * 4).cast("bigint").alias("used"), F.when(F.col("l_tax") > 0, F.col("l_shipdate")).alias("grant_time"))
    flags = ["flag_pending", "flag_excessive", "flag_underused"]
    return count_by(rules.grant_flags(rows, "granted", "used", "grant_time"), ["l_returnflag", "l_linestatus"], {f: F.col(f) for f in flags})


@bind("rul11_frag_flags", """
SELECT l_suppkey, fragmentation, fill_factor_flag, count(*) AS rows FROM (
  SELECT l_suppkey, CASE WHEN p > 8 * 5 AND n > 1000 THEN 'HIGH' WHEN p > 30 AND n > 1000 THEN 'HIGH' WHEN p > 10 AND n > 1000 THEN 'MEDIUM' ELSE 'OK' END AS fragmentation,
         CASE WHEN f IN (0, 80, 85, 90) THEN 'OK' ELSE 'NONSTANDARD_FILLFACTOR' END AS fill_factor_flag
  FROM (SELECT l_suppkey, CAST(round(l_discount * 400) AS BIGINT) AS p, CAST(l_quantity AS BIGINT) * 50 AS n, CAST(round(l_tax * 1000) AS BIGINT) + 10 AS f FROM lineitem) WHERE n > 100)
GROUP BY ALL""")
def rul11(t):
    rows = t.lineitem.select("l_suppkey", F.round(F.col("l_discount") * 400).cast("bigint").alias("pct"), (F.col("l_quantity").cast("bigint") * 50).alias("pages"),
                             (F.round(F.col("l_tax") * 1000).cast("bigint") + 10).alias("fill"))
    return count_by(rules.frag_flags(rows, "pct", "pages", "fill"), ["l_suppkey", "fragmentation", "fill_factor_flag"])


@bind("rul12_rowgroup_flags", """
SELECT o_orderpriority, deleted_flag, undersized_flag, open_flag, count(*) AS rows FROM (
  SELECT o_orderpriority, CASE WHEN t > 0 AND d * 5 > t THEN 'HIGH_DELETED_ROWS' ELSE '' END AS deleted_flag,
    CASE WHEN t < 102400 AND s = 'COMPRESSED' THEN 'UNDERSIZED_ROWGROUP' ELSE '' END AS undersized_flag, CASE WHEN s = 'OPEN' THEN 'TUPLE_MOVER_BACKLOG' ELSE '' END AS open_flag
  FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) // 2 * (CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE 1 END) AS t, o_custkey * 30 AS d,
               CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'COMPRESSED' ELSE 'CLOSED' END AS s FROM orders)) GROUP BY ALL""")
def rul12(t):
    rows = t.orders.select("o_orderpriority", F.when(F.col("o_custkey") % 10 == 0, 0).otherwise(int_div(F.floor("o_totalprice"), F.lit(2))).alias("total"),
                           (F.col("o_custkey") * 30).alias("deleted"),
                           F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "COMPRESSED").otherwise("CLOSED").alias("state"))
    return count_by(rules.rowgroup_flags(rows, "total", "deleted", "state"), ["o_orderpriority", "deleted_flag", "undersized_flag", "open_flag"])


@bind("rul13_freshness", f"""
SELECT o_orderkey, date_diff('day', u, TIMESTAMP '{ORDERS_NOW}') AS days_since_update, {half_up('s', 'n', 1, 100)} AS sample_pct,
  CASE WHEN u IS NULL THEN 'NEVER_UPDATED' WHEN date_diff('day', u, TIMESTAMP '{ORDERS_NOW}') > 30 AND m > 1000 THEN 'STALE_HIGH_MODS' WHEN m > n * 0.2 THEN 'HIGH_MOD_RATE' ELSE 'OK' END AS freshness,
  CASE WHEN n > 0 AND s * 10 < n THEN 'LOW_SAMPLE' ELSE 'OK' END AS sample_flag
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS u, CAST(floor(o_totalprice) AS BIGINT) AS n, o_custkey * 20 AS s, o_orderkey % 3000 AS m FROM orders)""")
def rul13(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("updated"), F.floor("o_totalprice").alias("n"),
                           (F.col("o_custkey") * 20).alias("sampled"), (F.col("o_orderkey") % 3000).alias("mods"))
    return rules.freshness(rows, "updated", "n", "sampled", "mods", ORDERS_NOW).drop("updated", "n", "sampled", "mods")


@bind("rul14_owner_class", """
SELECT s_suppkey, owner, CASE WHEN owner IS NULL THEN 1 WHEN lower(owner) = 'sa' OR owner ILIKE '%svc%' OR owner ILIKE '%nt authority%' OR owner ILIKE '%agent%' THEN 0 ELSE 1 END AS flag_personal_owner
FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'sa' WHEN 1 THEN 'SVC_' || s_name WHEN 2 THEN 'NT AUTHORITY\\' || n_name WHEN 3 THEN s_name END AS owner
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def rul14(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 5
    owner = (F.when(k == 0, "sa").when(k == 1, F.concat(F.lit("SVC_"), F.col("s_name")))
             .when(k == 2, F.concat(F.lit("NT AUTHORITY\\"), F.col("n_name"))).when(k == 3, F.col("s_name")))
    return rules.owner_class(rows.select("s_suppkey", owner.alias("owner")), "owner")


@bind("rul15_suspicious_objects", """
SELECT p_brand, CASE p_partkey % 3 WHEN 0 THEN 'Suffix: _old' ELSE 'Date-suffix pattern detected' END AS pattern, count(*) AS objects, CAST(sum(p_size) AS BIGINT) AS total_size
FROM part WHERE p_partkey % 3 < 2 GROUP BY ALL""")
def rul15(t):
    k = F.col("p_partkey") % 3
    tail = F.when(k == 0, "_OLD").when(k == 1, "_2024").otherwise("")
    return rules.suspicious_objects(t.part.withColumn("object", F.concat("p_name", tail)), "object", F.col("p_size"), ["p_brand"])


@bind("rul16_scan_secrets", """
SELECT source, p AS pattern, count(*) AS texts FROM documents JOIN (VALUES ('token = '), ('password'), ('license')) v(p) ON contains(lower(text), p) GROUP BY 1, 2""")
def rul16(t):
    return rules.scan_secrets(t.documents, "text", ["source"], ["token = ", "password", "license"])


@bind("rul17_marker_flags", """
SELECT source, lang, count(*) AS texts, count(*) FILTER (WHERE text LIKE '%license%' OR text LIKE '%License%') AS license, count(*) FILTER (WHERE text LIKE '%token%') AS token,
       count(*) FILTER (WHERE text LIKE '%@%') AS address
FROM documents WHERE text LIKE '%license%' OR text LIKE '%License%' OR text LIKE '%token%' OR text LIKE '%@%' GROUP BY 1, 2""")
def rul17(t):
    marks = {"license": ["license", "License"], "token": ["token"], "address": ["@"]}
    return rules.marker_summary(rules.marker_flags(t.documents, "text", marks), ["source", "lang"], list(marks))


_REPLICA = """(SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS conn,
  CASE WHEN o_custkey % 3 = 0 THEN 'NOT_HEALTHY' ELSE 'HEALTHY' END AS health, CASE WHEN o_custkey % 2 = 0 THEN 'SYNCHRONOUS_COMMIT' ELSE 'ASYNCHRONOUS_COMMIT' END AS mode,
  CASE WHEN o_custkey % 5 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS oper, CASE WHEN o_custkey % 7 = 0 THEN 'RESOLVING' ELSE 'SECONDARY' END AS role,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'AUTOMATIC' WHEN o_orderpriority = '5-LOW' THEN 'EXTERNAL' ELSE 'MANUAL' END AS failover, o_orderdate AS err FROM orders)"""


def _replicas(t):
    k = F.col("o_custkey")
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    return t.orders.select(
        "o_orderkey", "o_orderpriority", pick(F.col("o_orderstatus") == "F", "DISCONNECTED", "CONNECTED").alias("conn"), pick(k % 3 == 0, "NOT_HEALTHY", "HEALTHY").alias("health"),
        pick(k % 2 == 0, "SYNCHRONOUS_COMMIT", "ASYNCHRONOUS_COMMIT").alias("mode"), pick(k % 5 == 0, "OFFLINE", "ONLINE").alias("oper"), pick(k % 7 == 0, "RESOLVING", "SECONDARY").alias("role"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "AUTOMATIC").when(F.col("o_orderpriority") == "5-LOW", "EXTERNAL").otherwise("MANUAL").alias("failover"),
        F.col("o_orderdate").alias("err"))


@bind("rul18_replica_flags", f"""
SELECT replica_flag, commit_flag, lease_flag, count(*) AS rows FROM (SELECT
  CASE WHEN conn <> 'CONNECTED' THEN 'DISCONNECTED_REPLICA' WHEN health <> 'HEALTHY' THEN 'UNHEALTHY_REPLICA' ELSE '' END AS replica_flag,
  CASE WHEN mode = 'SYNCHRONOUS_COMMIT' AND conn <> 'CONNECTED' THEN 'SYNC_COMMIT_DISCONNECTED' WHEN mode = 'SYNCHRONOUS_COMMIT' AND health <> 'HEALTHY' THEN 'SYNC_COMMIT_NOT_HEALTHY' ELSE '' END AS commit_flag,
  CASE WHEN conn = 'DISCONNECTED' AND err >= TIMESTAMP '2001-07-31 00:00:00' THEN 'RECENT_DISCONNECT' WHEN conn = 'DISCONNECTED' THEN 'DISCONNECTED'
       WHEN oper NOT IN ('ONLINE', 'ONLINE_IN_PROGRESS') AND role <> 'RESOLVING' THEN 'OPERATIONAL_STATE_WARN' WHEN err >= TIMESTAMP '2001-07-31 00:00:00' AND conn = 'CONNECTED' THEN 'RECENT_ERROR_NOW_CONNECTED' ELSE '' END AS lease_flag
  FROM {_REPLICA}) GROUP BY ALL""")
def rul18(t):
    return count_by(rules.replica_flags(_replicas(t), "conn", "health", "mode", "oper", "role", "err", "2001-08-01 00:00:00"), ["replica_flag", "commit_flag", "lease_flag"])


@bind("rul19_readiness", f"""
SELECT o_orderpriority, CASE WHEN failover = 'MANUAL' THEN 'MANUAL_FAILOVER_ONLY' WHEN failover <> 'AUTOMATIC' THEN '' WHEN conn <> 'CONNECTED' THEN 'NOT_READY_DISCONNECTED'
   WHEN health <> 'HEALTHY' THEN 'NOT_READY_UNHEALTHY' ELSE 'FAILOVER_READY' END AS failover_readiness, count(*) AS rows FROM {_REPLICA} GROUP BY ALL""")
def rul19(t):
    return count_by(rules.readiness(_replicas(t), "failover", "conn", "health"), ["o_orderpriority", "failover_readiness"])


@bind("rul21_age_flags", f"""
SELECT event_id, date_diff('minute', ts, TIMESTAMP '{EVENTS_NOW}') AS age, CASE WHEN date_diff('minute', ts, TIMESTAMP '{EVENTS_NOW}') >= 1440 THEN 1 ELSE 0 END AS flag_over_1440_minute,
  CASE WHEN date_diff('minute', ts, TIMESTAMP '{EVENTS_NOW}') >= 10080 THEN 1 ELSE 0 END AS flag_over_10080_minute, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS flag_over_size
FROM events""")
def rul21(t):
    out = rules.age_flags(t.events, "ts", EVENTS_NOW, (1440, 10080), size="value", size_limit=100)
    return out.select("event_id", "age", "flag_over_1440_minute", "flag_over_10080_minute", "flag_over_size")
