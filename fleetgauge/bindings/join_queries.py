"""Join jobs on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import bind, cents, half_up, money
from fleetgauge.functions.labels import flag
from fleetgauge.functions.numbers import exact, ratio, row_count
from fleetgauge.operators import joins
from fleetgauge.operators.aggregates import count_by
from fleetgauge.operators.overlap import signature
from fleetgauge.session import write_once


@bind("joi1_attach", f"""
SELECT n_name, c_mktsegment, o_orderstatus, count(*) AS rows, CAST(sum({money('l_extendedprice')}) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def joi1(t):
    rows = joins.attach(t.lineitem, [(t.orders, {"l_orderkey": "o_orderkey"}, "inner"), (t.customer, {"o_custkey": "c_custkey"}, "inner"),
                                     (t.nation, {"c_nationkey": "n_nationkey"}, "left")])
    return count_by(rows, ["n_name", "c_mktsegment", "o_orderstatus"], {"revenue": exact(F.col("l_extendedprice"))})


@bind("joi2_coverage", """
SELECT c_custkey, coalesce(n, 0) AS matches, last_failed, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS flag_missing
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_failed FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) ON o_custkey = c_custkey""")
def joi2(t):
    failed = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))).withColumnRenamed("o_custkey", "c_custkey")
    return joins.coverage(t.customer.select("c_custkey"), failed, ["c_custkey"], {"last_failed": F.max("o_orderdate")})


@bind("joi3_coverage_gap", """
SELECT event_id, event_type, 'ACTUAL' AS row_kind FROM events
UNION ALL SELECT NULL, v, 'COVERAGE GAP: ' || v FROM (VALUES ('signup'), ('purchase'), ('login'), ('logout')) x(v) WHERE v NOT IN (SELECT event_type FROM events WHERE value > 1)""")
def joi3(t):
    return joins.coverage_gap(t.events.select("event_id", "event_type", "value"), ["signup", "purchase", "login", "logout"], "event_type", F.col("value") > 1).drop("value")


@bind("joi4_has_match", """
SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1, 2""")
def joi4(t):
    returned = t.lineitem.filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return count_by(joins.has_match(t.orders, returned, ["o_orderkey"]), ["o_orderstatus", "o_orderpriority"])


@bind("joi5_unsupported_keys", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def joi5(t):
    lead = t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return joins.unsupported_keys(t.part.select("p_partkey", "p_name"), lead, ["p_partkey"])


@bind("joi6_orphans", """
SELECT o_custkey, count(*) AS rows FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey WHERE c_custkey IS NULL GROUP BY 1""")
def joi6(t):
    known = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return count_by(joins.orphans(t.orders, known, ["o_custkey"]), ["o_custkey"])


@bind("joi7_pairs", """
WITH sig AS (SELECT o_custkey, l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS list FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT a.o_custkey, min(a.l_orderkey) AS first_key, b.l_orderkey AS other_key, b.list, any_value(n) AS members, any_value(n * (n - 1) // 2) AS pair_count
FROM sig a JOIN sig b ON a.o_custkey = b.o_custkey AND b.l_orderkey > a.l_orderkey AND a.list = b.list
JOIN (SELECT o_custkey, list, count(*) AS n FROM sig GROUP BY 1, 2) s ON s.o_custkey = b.o_custkey AND s.list = b.list GROUP BY a.o_custkey, b.l_orderkey, b.list""")
def joi7(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sig = write_once(signature(rows, ["o_custkey", "l_orderkey"], ["l_linenumber"], "l_returnflag"), "joi7")
    return joins.pairs(sig.withColumn("list", F.array_join("key_columns", ",")), ["o_custkey"], "l_orderkey", ["list"])


@bind("joi8_attach_scalar", f"""
SELECT s_suppkey, {half_up('total', '100 * n')} AS mean_balance, n AS suppliers, CASE WHEN {cents('s_acctbal')} * n > total THEN 1 ELSE 0 END AS flag_above
FROM supplier, (SELECT CAST(sum({cents('s_acctbal')}) AS BIGINT) AS total, count(*) AS n FROM supplier)""")
def joi8(t):
    b = exact(F.col("s_acctbal"))
    rows = joins.attach_scalar(t.supplier, t.supplier.agg(ratio(F.sum(b), row_count()).alias("mean_balance"), row_count().alias("suppliers"), F.sum(b).alias("_sum")))
    return rows.select("s_suppkey", "mean_balance", "suppliers", flag(b * F.col("suppliers") > F.col("_sum")).alias("flag_above"))


@bind("joi9_counts_per", f"""
SELECT c_custkey, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS done, CAST(sum({money('o_totalprice')}) AS DOUBLE) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1""")
def joi9(t):
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).withColumnRenamed("o_custkey", "c_custkey")
    return joins.counts_per(t.customer.select("c_custkey"), recent, ["c_custkey"], {"orders": None, "done": F.col("o_orderstatus") == "O"},
                            {"total": exact(F.col("o_totalprice"))})


_BLOCKED = "(SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id // 7 ELSE 0 END AS blocker, CAST(round(value * 100) AS BIGINT) AS wait_ms FROM events)"


def _sessions(t):
    return t.events.select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.floor(F.col("event_id") / 7)).otherwise(0).cast("bigint").alias("blocker"),
                           F.round(F.col("value") * 100).cast("bigint").alias("wait_ms"))


@bind("joi10_blocking_pairs", f"""
SELECT r.event_id, r.blocker, r.event_type, b.event_type AS blocker_event_type, r.wait_ms / 1000.0 AS wait_sec FROM {_BLOCKED} r LEFT JOIN events b ON b.event_id = r.blocker WHERE r.blocker > 0""")
def joi10(t):
    return joins.blocking(_sessions(t), "event_id", "blocker", "wait_ms", ["event_type"]).pairs


@bind("joi10_blocking_summary", f"""
SELECT count(DISTINCT blocker) AS direct_blockers, count(*) AS blocked_sessions, max(wait_ms) / 1000.0 AS max_wait_sec, {half_up('sum(wait_ms)', '1000 * count(*)', 3)} AS avg_wait_sec
FROM {_BLOCKED} WHERE blocker > 0""")
def joi10s(t):
    return joins.blocking(_sessions(t), "event_id", "blocker", "wait_ms").summary


@bind("joi11_shares_location", """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000)) THEN 'Y' ELSE 'N' END AS shares_location FROM customer""")
def joi11(t):
    bucket = lambda c: F.floor(F.col(c) / 1000).alias("spot")
    a = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), bucket("c_acctbal"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), bucket("s_acctbal"))
    return joins.shares_location(a, b, ["nation"], ["spot"]).select("c_custkey", "shares_location")


@bind("joi12_misaligned", """
SELECT i.l_orderkey, i.l_linenumber, i.l_suppkey, base.l_suppkey AS base_l_suppkey, count(*) AS rows
FROM lineitem i JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) base ON base.l_orderkey = i.l_orderkey
WHERE i.l_linenumber > 1 AND i.l_suppkey <> base.l_suppkey GROUP BY 1, 2, 3, 4""")
def joi12(t):
    rows = joins.misaligned(t.lineitem, ["l_orderkey"], F.col("l_linenumber") > 1, F.col("l_linenumber") == 1, "l_suppkey")
    return count_by(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "base_l_suppkey"])


@bind("joi13_reconcile", f"""
SELECT coalesce(o_orderkey, l_orderkey) AS k, CASE WHEN l_orderkey IS NULL THEN 'ONLY_FIRST' WHEN o_orderkey IS NULL THEN 'ONLY_SECOND' ELSE 'BOTH' END AS presence,
  CAST(a AS DOUBLE) AS a_amount, CAST(b AS DOUBLE) AS b_amount, CAST(a - b AS DOUBLE) AS diff_amount
FROM (SELECT o_orderkey, sum({money('o_totalprice')}) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
FULL JOIN (SELECT l_orderkey, sum({money('l_extendedprice')}) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def joi13(t):
    a = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), exact(F.col("o_totalprice")).alias("amount"))
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), exact(F.col("l_extendedprice")).alias("amount"))
    return joins.reconcile(a, b, ["k"], ["amount"])
