"""Duplicate and overlap jobs on the supplied tables: an order stands for an index, its
customer for the table, the return flags of its lines for the key columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import bind
from fleetgauge.operators import overlap
from fleetgauge.session import write_once


def _of_orders(t, sig):
    """Signatures per order, then the order's customer and status: lists travel once."""
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return sig.join(owner, "l_orderkey")


def _signatures(t):
    return _of_orders(t, overlap.signature(t.lineitem, ["l_orderkey"], ["l_linenumber"], "l_returnflag", F.col("l_linestatus") == "F", F.col("l_linenumber") == 7))


def _plain_signatures(t, label):
    """Signatures that several branches read: written once."""
    return write_once(_of_orders(t, overlap.signature(t.lineitem, ["l_orderkey"], ["l_linenumber"], "l_returnflag")), label)


_SIG = """sig AS (SELECT o_custkey, l_orderkey, o_orderstatus,
   coalesce(string_agg(l_returnflag || CASE l_linestatus WHEN 'F' THEN ':DESC' ELSE ':ASC' END, ',' ORDER BY l_linenumber, l_returnflag || CASE l_linestatus WHEN 'F' THEN ':DESC' ELSE ':ASC' END) FILTER (WHERE l_linenumber <> 7), '') AS keys,
   coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE l_linenumber = 7), '') AS inc
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


@bind("dup1_signature", f"WITH {_SIG} SELECT o_custkey, l_orderkey, o_orderstatus, keys AS key_text, inc AS include_text FROM sig")
def dup1(t):
    return _signatures(t).select("o_custkey", "l_orderkey", "o_orderstatus", F.array_join("key_columns", ",").alias("key_text"),
                                 F.array_join("include_columns", ",").alias("include_text"))


@bind("dup2_duplicate_pairs", f"""
WITH {_SIG}, k AS (SELECT * FROM sig WHERE keys <> ''),
 p AS (SELECT a.o_custkey, a.l_orderkey AS a, b.l_orderkey AS b, CASE WHEN a.keys = b.keys AND a.inc = b.inc AND a.o_orderstatus = b.o_orderstatus THEN 'EXACT_DUPLICATE'
         WHEN b.keys LIKE a.keys || ',%' THEN 'PREFIX' END AS kind, a.keys AS akeys, a.inc AS ainc, a.o_orderstatus AS af
       FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.l_orderkey <> b.l_orderkey)
SELECT o_custkey, min(a) AS index_1, b AS index_2, 'EXACT_DUPLICATE' AS duplicate_type, count(*) + 1 AS set_size FROM p WHERE kind = 'EXACT_DUPLICATE' GROUP BY o_custkey, b HAVING min(a) < b
UNION ALL
SELECT o_custkey, least(min(a), b), greatest(min(a), b), CASE WHEN min(a) < b THEN 'INDEX1_IS_PREFIX' ELSE 'INDEX2_IS_PREFIX' END, count(*) FROM p WHERE kind = 'PREFIX' GROUP BY o_custkey, b, akeys""")
def dup2(t):
    return overlap.duplicate_pairs(write_once(_signatures(t), "dup2"), ["o_custkey"], "l_orderkey", "o_orderstatus")


@bind("dup2_families", f"""
WITH {_SIG}, k AS (SELECT *, string_split(keys, ',') AS l FROM sig WHERE keys <> ''),
 d AS (SELECT DISTINCT o_custkey, l FROM k),
 ev AS (SELECT o_custkey, l, l AS s FROM d UNION ALL SELECT o_custkey, l, list_append(l, chr(1114111)) FROM d),
 n AS (SELECT o_custkey, l, row_number() OVER (ORDER BY o_custkey, s) AS place FROM ev),
 t AS (SELECT o_custkey, l, min(place) AS entry, max(place) AS exit FROM n GROUP BY ALL)
SELECT k.o_custkey, l_orderkey, entry, exit, min(l_orderkey) OVER same AS first_equal, count(*) OVER same AS set_size, (SELECT count(*) FROM d WHERE d.o_custkey = k.o_custkey AND len(d.l) > len(k.l) AND d.l[1:len(k.l)] = k.l) AS longer_lists
FROM k JOIN t ON t.o_custkey = k.o_custkey AND t.l = k.l WINDOW same AS (PARTITION BY k.o_custkey, keys, inc, o_orderstatus)""")
def dup2_families(t):
    return overlap.duplicate_families(write_once(_signatures(t), "dup2"), ["o_custkey"], "l_orderkey", "o_orderstatus")


@bind("dup2_all_pairs", f"""
WITH {_SIG}, k AS (SELECT * FROM sig WHERE keys <> ''),
 p AS (SELECT a.o_custkey, a.l_orderkey AS index_1, b.l_orderkey AS index_2, CASE WHEN a.keys = b.keys AND a.inc = b.inc AND a.o_orderstatus = b.o_orderstatus THEN 'EXACT_DUPLICATE'
         WHEN b.keys LIKE a.keys || ',%' THEN 'INDEX1_IS_PREFIX' WHEN a.keys LIKE b.keys || ',%' THEN 'INDEX2_IS_PREFIX' END AS duplicate_type
       FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.l_orderkey < b.l_orderkey)
SELECT * FROM p WHERE duplicate_type IS NOT NULL""")
def dup2_all_pairs(t):
    return overlap.family_pairs(write_once(dup2_families(t), "families"), ["o_custkey"], "l_orderkey")


@bind("dup3_overlapping_stats", """
WITH sig AS (SELECT o_custkey, l_orderkey, o_orderstatus, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS list FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
 n AS (SELECT o_custkey, list, o_orderstatus, count(*) AS set_size FROM sig GROUP BY 1, 2, 3)
SELECT a.o_custkey, min(a.l_orderkey) AS stat_1, b.l_orderkey AS stat_2, a.list AS column_list,
  CASE WHEN a.list = b.list AND a.o_orderstatus = b.o_orderstatus THEN 'EXACT_DUPLICATE' ELSE 'OVERLAPPING_PREFIX' END AS duplicate_type, any_value(set_size) AS set_size
FROM sig a JOIN sig b ON a.o_custkey = b.o_custkey AND b.l_orderkey > a.l_orderkey AND starts_with(b.list, a.list)
JOIN n ON n.o_custkey = a.o_custkey AND n.list = a.list AND n.o_orderstatus = a.o_orderstatus GROUP BY a.o_custkey, b.l_orderkey, a.list, a.o_orderstatus, b.list, b.o_orderstatus""")
def dup3(t):
    sig = _plain_signatures(t, "dup3")
    return overlap.overlapping_stats(sig, ["o_custkey"], "l_orderkey", "o_orderstatus")


def _wanted_existing(t):
    """Failed orders ask for an index, all others have one."""
    sig = _plain_signatures(t, "dup45").withColumnRenamed("key_columns", "keys")
    name = sig.withColumn("index_name", F.format_string("ix_%08d", "l_orderkey"))
    return name.filter("o_orderstatus = 'F'"), name.filter("o_orderstatus <> 'F'")


_COMPARED = """
 sig AS (SELECT o_custkey, l_orderkey, o_orderstatus, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS keys FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
 w AS (SELECT DISTINCT o_custkey, keys FROM sig WHERE o_orderstatus = 'F'), e AS (SELECT o_custkey, keys, printf('ix_%08d', l_orderkey) AS name FROM sig WHERE o_orderstatus <> 'F'),
 m AS (SELECT w.o_custkey, w.keys AS wk, e.keys AS ek, name, len(list_filter(range(1, least(len(w.keys), len(e.keys)) + 1), lambda i: w.keys[1:i] = e.keys[1:i])) AS p FROM w JOIN e USING (o_custkey)),
 c AS (SELECT o_custkey, wk, CASE WHEN p = len(wk) AND p = len(ek) THEN 'EXACT_KEY_MATCH' WHEN p = len(ek) THEN 'EXISTING_IS_PREFIX_OF_MISSING' WHEN p = len(wk) THEN 'MISSING_IS_PREFIX_OF_EXISTING'
          WHEN p = 1 THEN 'SAME_FIRST_KEY_ONLY' ELSE 'PARTIAL_LEADING_MATCH' END AS match_type, p, count(*) AS n, min(name) AS first_name FROM m WHERE p > 0 GROUP BY ALL)"""


@bind("dup4_compare_keys", f"""WITH {_COMPARED}
SELECT o_custkey, array_to_string(wk, ',') AS wanted, match_type, p::INTEGER AS prefix_length, n AS indexes, first_name AS first_index FROM c""")
def dup4(t):
    wanted, existing = _wanted_existing(t)
    return (overlap.compare_keys(wanted, existing, ["o_custkey"])
            .withColumn("wanted", F.array_join("wanted_keys", ",")).drop("wanted_keys"))


_MATCHES = """
 a AS (SELECT o_custkey, wk, ek, name, p, CASE WHEN p = len(wk) AND p = len(ek) THEN 'EXACT_KEY_MATCH' WHEN p = len(ek) THEN 'EXISTING_IS_PREFIX_OF_MISSING' WHEN p = len(wk) THEN 'MISSING_IS_PREFIX_OF_EXISTING'
          WHEN p = 1 THEN 'SAME_FIRST_KEY_ONLY' ELSE 'PARTIAL_LEADING_MATCH' END AS match_type FROM m WHERE p > 0)"""


@bind("dup4_all_matches", f"""WITH {_COMPARED}, {_MATCHES}
SELECT o_custkey, array_to_string(wk, ',') AS wanted, name AS index_name, match_type, p::INTEGER AS prefix_length, array_to_string(ek, ',') AS existing_keys FROM a""")
def dup4_all_matches(t):
    wanted, existing = _wanted_existing(t)
    existing = existing.withColumn("existing_keys", F.array_join("keys", ","))
    return (overlap.matching_indexes(wanted, existing, ["o_custkey"], carry=["existing_keys"])
            .withColumn("wanted", F.array_join("wanted_keys", ",")).drop("wanted_keys"))


@bind("dup5_evidence_text", f"""WITH {_COMPARED}, {_MATCHES},
 r AS (SELECT o_custkey, wk, string_agg(name || ' [' || match_type || CASE WHEN len(ek) > 3 THEN '; WIDE' ELSE '' END || '; prefix=' || p || '] (' || array_to_string(ek, ',') || ')', ' | ' ORDER BY
   CASE match_type WHEN 'EXACT_KEY_MATCH' THEN 1 WHEN 'MISSING_IS_PREFIX_OF_EXISTING' THEN 2 WHEN 'EXISTING_IS_PREFIX_OF_MISSING' THEN 3 WHEN 'PARTIAL_LEADING_MATCH' THEN 4 ELSE 5 END, p DESC, name) AS evidence FROM a GROUP BY 1, 2)
SELECT s.o_custkey, s.l_orderkey, coalesce(evidence, '[no relevant leading-key overlap]') AS evidence FROM sig s LEFT JOIN r ON r.o_custkey = s.o_custkey AND r.wk = s.keys WHERE s.o_orderstatus = 'F'""")
def dup5(t):
    wanted, existing = _wanted_existing(t)
    existing = existing.withColumns({"kind": F.when(F.size("keys") > 3, "WIDE"), "listed": F.concat(F.lit(" ("), F.array_join("keys", ","), F.lit(")"))})
    matches = overlap.matching_indexes(wanted, existing, ["o_custkey"], carry=["kind", "listed"])
    return overlap.evidence_text(wanted, matches, ["o_custkey"], details=F.col("kind"), tail=F.col("listed")).select("o_custkey", "l_orderkey", "evidence")


@bind("dup6_benefit", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(18,0)) * CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 10000 AS score,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE lower(l_returnflag) || 'key,status' END || CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN ',' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN 'tax' ELSE '' END AS normalised_keys,
  'INDEX IX_MI_items_' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || 'key_Status' END || CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN '_' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN 'Tax' ELSE '' END
  || ' ON items (' || CASE WHEN l_returnflag = 'N' THEN '' ELSE '[' || l_returnflag || 'key], [Status]' END || CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN ',' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN '[Tax]' ELSE '' END || ')'
  || CASE WHEN l_linenumber > 3 THEN ' INCLUDE ([Price])' ELSE '' END AS definition
FROM lineitem""")
def dup6(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_discount") * 100).alias("impact"), F.lit("items").alias("table"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("["), F.col("l_returnflag"), F.lit("key], [Status]"))).alias("eq"),
        F.when(F.col("l_linestatus") == "O", "[Tax]").alias("ineq"), F.when(F.col("l_linenumber") > 3, "[Price]").alias("inc"))
    out = overlap.benefit(rows, "table", "eq", "ineq", "inc", F.col("l_quantity"), F.col("l_extendedprice"), F.round("impact"))
    return out.select("l_orderkey", "l_linenumber", "score", "normalised_keys", "definition")


@bind("dup7_usage_class", """
SELECT p_partkey, coalesce(r, 0) AS reads, coalesce(w, 0) AS writes, CASE WHEN coalesce(r, 0) > 0 THEN 'HAS_READS' WHEN coalesce(w, 0) > 0 THEN 'WRITE_ONLY_CANDIDATE' ELSE 'ZERO_USAGE' END AS usage
FROM part LEFT JOIN (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 40 AND l_linenumber < 4) AS r, count(*) FILTER (WHERE l_linenumber = 7) AS w FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def dup7(t):
    usage = t.lineitem.select(F.col("l_partkey").alias("p_partkey"),
                              F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40) & (F.col("l_linenumber") < 4), 1).otherwise(0).alias("reads"),
                              F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("writes"))
    return overlap.usage_class(t.part.select("p_partkey"), usage, ["p_partkey"])
