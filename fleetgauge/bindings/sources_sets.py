"""Sources, sinks and set jobs on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.bindings.registry import EVENTS_NOW, bind
from fleetgauge.operators import sets
from fleetgauge.plans import findings
from fleetgauge.session import scratch_dir
from fleetgauge.sources import sections

STAMP = "2024-01-31T00:00:00Z"
LOG_STATUS = {"signup": "OK", "purchase": "OK", "view": "SKIP", "click": "WARN", "error": "ERROR"}


def _export(df, root, server):
    (df.withColumns({"CollectedAt": F.lit(STAMP), "SqlInstance": F.lit(server)})
     .write.option("header", True).csv(f"{root}/{server}"))


@bind("src1_read_section", f"""
SELECT event_id, event_type, CASE WHEN a THEN value END AS value, CASE WHEN NOT a THEN user_id END AS user_id,
       CASE WHEN a THEN 'srv_a' ELSE 'srv_b' END AS sql_instance, TIMESTAMP '{EVENTS_NOW}' AS collected_at
FROM (SELECT *, event_type IN ('error', 'click') AS a FROM events)""")
def src1(t):
    root = scratch_dir(t.spark, "src1")
    one = F.col("event_type").isin("error", "click")
    _export(t.events.filter(one).select("event_id", "event_type", "value"), root, "srv_a")
    _export(t.events.filter(~one).select("user_id", "event_type", "event_id"), root, "srv_b")
    _export(t.spark.range(1).select(F.lit(sections.EMPTY_NOTE).alias("Note")), root, "srv_c")
    out = sections.read_section(t.spark, f"{root}/*/*.csv", "event_id BIGINT, event_type STRING, value DOUBLE, user_id BIGINT")
    # shown in UTC whatever the session's zone
    return out.withColumn("collected_at", F.convert_timezone(None, F.lit("UTC"), F.col("collected_at").cast("timestamp_ntz")))


@bind("src3_empty_marker", """
SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS "Note" FROM orders WHERE o_totalprice < 0
UNION ALL SELECT NULL, NULL, 'No data returned' WHERE (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0""")
def src3(t):
    return sections.with_empty_marker(t.orders.filter("o_totalprice < 0").select("o_orderkey", "o_orderstatus"))


@bind("src4_merge_sets", """
SELECT c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS INTEGER) AS nation, 'CUSTOMERS' AS "ResultSetName" FROM customer
UNION ALL SELECT s_name, NULL, NULL, s_nationkey, 'SUPPLIERS' FROM supplier
UNION ALL SELECT p_name, NULL, p_brand, NULL, 'PARTS' FROM part""")
def src4(t):
    return sections.merge_sets({
        "CUSTOMERS": t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "SUPPLIERS": t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        "PARTS": t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))})


@bind("src5_write_section", f"""
SELECT c_custkey, c_name, c_acctbal, 'n' || c_nationkey AS sql_instance, DATE '2024-01-31' AS run_date FROM customer""")
def src5(t):
    root = scratch_dir(t.spark, "src5")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("sql_instance"),
                             F.lit(EVENTS_NOW).cast("timestamp_ntz").alias("collected_at"))
    path = sections.write_section(rows, root, "customers")
    return t.spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal", "sql_instance", F.col("run_date").cast("date").alias("run_date"))


def _log_lines(t):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in LOG_STATUS.items() for x in kv]), F.col("event_type"))
    chapter = F.concat(F.lit("ch_"), F.col("user_id").cast("string"))
    message = (F.when(status == "OK", F.concat(F.lit("Exported "), F.col("event_id").cast("string"), F.lit(" rows to file.csv")))
               .when(status == "ERROR", "Login failed [code 1]").otherwise("not enabled"))
    return t.events.select(F.format_string(
        "[%s] [%s] [%s] [%s] %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), status, chapter,
        F.concat(F.lit("s_"), F.col("event_type")), message).alias("value"))


_LOG_CASE = "CASE event_type WHEN 'view' THEN 'SKIP' WHEN 'click' THEN 'WARN' WHEN 'error' THEN 'ERROR' ELSE 'OK' END"


_LOG_ROWS = f"""
SELECT date_trunc('second', ts) AS logged_at, {_LOG_CASE} AS status, 'ch_' || user_id AS chapter, 's_' || event_type AS section,
       CASE {_LOG_CASE} WHEN 'OK' THEN 'Exported ' || event_id || ' rows to file.csv' WHEN 'ERROR' THEN 'Login failed [code 1]' ELSE 'not enabled' END AS message,
       CASE WHEN {_LOG_CASE} = 'OK' THEN event_id END AS rows_exported
FROM events"""


@bind("src6_parse_run_log", _LOG_ROWS)
def src6(t):
    return sections.parse_run_log(_log_lines(t))


@bind("src6_encoded_run_log", _LOG_ROWS)
def src6_encoded(t):
    """The same log written and read in its two-byte encoding."""
    path = sections.write_run_log(_log_lines(t), scratch_dir(t.spark, "src6"))
    return sections.parse_run_log(sections.read_run_log(t.spark, path))


@bind("fnd3_run_summary", f"""
SELECT 'ch_' || user_id AS chapter, count(*) FILTER (WHERE s IN ('OK','WARN','ERROR')) AS sections_run,
       count(*) FILTER (WHERE s IN ('OK','WARN')) AS sections_ok, count(*) FILTER (WHERE s = 'ERROR') AS sections_failed,
       count(*) FILTER (WHERE s = 'SKIP') AS sections_skipped,
       CAST(coalesce(sum(event_id) FILTER (WHERE s = 'OK'), 0) AS BIGINT) AS rows_exported,
       CASE WHEN bool_or(s = 'ERROR') THEN 'PARTIAL' WHEN bool_and(s = 'SKIP') THEN 'SKIP' ELSE 'OK' END AS chapter_status
FROM (SELECT *, {_LOG_CASE} AS s FROM events) GROUP BY user_id""")
def fnd3(t):
    return findings.run_summary(sections.parse_run_log(_log_lines(t)))


@bind("src7_split_failures", """
SELECT l_returnflag, CASE WHEN l_discount = 0 OR l_tax = 0.08 THEN 'failed' ELSE 'good' END AS side, count(*) AS rows,
       CAST(sum(CASE WHEN l_discount = 0 THEN -1 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS pages
FROM lineitem GROUP BY ALL""")
def src7(t):
    rows = t.lineitem.select("l_returnflag", F.when(F.col("l_discount") == 0, -1).otherwise(F.col("l_quantity").cast("bigint")).alias("pages"),
                             F.when(F.col("l_tax") == 0.08, "ERROR: no access").otherwise("").alias("state"))
    split = sections.split_failures(rows, ["pages"], ["state"])
    both = sets.append_branches({"good": split.good, "failed": split.failed}, "side")
    return both.groupBy("l_returnflag", "side").agg(F.count(F.lit(1)).alias("rows"), F.sum("pages").alias("pages"))


@bind("src8_fan_in", """
SELECT event_type AS database, count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1""")
def src8(t):
    kinds = ["signup", "purchase", "error", "view", "click"]
    every = sections.fan_in({k: t.events.filter(F.col("event_type") == k).select("user_id", "value") for k in kinds})
    return every.groupBy("database").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"),
                                         F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


@bind("set1_append_branches", """
SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS branch FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def set1(t):
    return sets.append_branches({
        "customer": t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "supplier": t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))})


@bind("set2_distinct_refs", """
SELECT c_nationkey AS ref FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT CAST(l_linenumber AS INTEGER) FROM lineitem""")
def set2(t):
    return sets.distinct_refs([(t.customer, "c_nationkey"), (t.supplier, "s_nationkey"), (t.lineitem, "l_linenumber")])


@bind("set3_dedup_rows", """
SELECT source, count(*) AS texts FROM (
  SELECT DISTINCT source, text FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR lang = 'en') GROUP BY 1""")
def set3(t):
    low = F.lower("text")
    d = t.documents
    found = d.filter(low.contains("license")).unionByName(d.filter(low.contains("token"))).unionByName(d.filter("lang = 'en'"))
    return sets.dedup_rows(found, ["source", "text"]).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
