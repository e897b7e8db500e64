"""Splitting hot keys must not change any result. `hot_rows` is set so low that most keys
are split into many pieces, and one key holds a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge.operators import joins, windows
from fleetgauge.operators.overlap import duplicate_pairs, signature
from fleetgauge.operators.skew import Scan, attach_group, hot_keys, ordered_scan, salted_join
from tests.conftest import rows


@pytest.fixture(scope="module")
def events(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    hot = F.when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 41 == 0, None).otherwise(F.col("user_id"))
    when = F.when(F.col("event_id") % 17 != 0, F.col("ts"))  # some times are missing
    tied = F.date_trunc("hour", when).cast("timestamp_ntz")  # many times are equal
    return e.withColumns({"user_id": hot, "ts": F.when(F.col("event_id") % 2 == 0, tied).otherwise(when)})


@pytest.mark.parametrize("hot_rows", [1, 5, 40, 10_000_000])
def test_ordered_scan_equals_plain_windows(events, hot_rows):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_first(), "event_id")
    wk = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").asc_nulls_first(), "event_id")
    events = events.withColumns({"number": F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 7), "rare": F.when(F.col("event_id") % 19 == 0, F.col("event_id"))})
    plain = events.select("*", F.lag("ts").over(w).alias("p_ts"), F.lag("event_type").over(w).alias("p_type"),
                          F.lag("value").over(wk).alias("p_value"),
                          F.max("event_id").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"),
                          F.sum("number").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("so_far"),
                          F.last("rare", True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("p_rare"))
    split = ordered_scan(events, ["user_id"], ["ts", "event_id"], [
        Scan(previous={"p_ts": "ts", "p_type": "event_type"}, prior_max={"top": "event_id"}, prior_sum={"so_far": "number"}),
        Scan(previous={"p_value": "value"}, prior_known={"p_rare": "rare"}, by=["event_type"])], hot_rows)
    assert rows(split, *plain.columns) == rows(plain)


def test_ordered_scan_splits_the_hot_key(events):
    exact = {r["_hot"]: r["count"] for r in events.groupBy(F.xxhash64("user_id").alias("_hot")).count().collect()}
    for known in (None, events.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rows"))):
        hot = {r["_hot"]: r["_rows"] for r in hot_keys(events, ["user_id"], 5, known).collect()}
        assert hot == {k: n for k, n in exact.items() if n >= 5} and max(hot.values()) * 3 >= events.count() * 0.9


def test_a_sketch_of_many_keys_still_finds_the_hot_ones(spark):
    """300,000 single keys, far more than the sketch counts, and two hot ones."""
    table = spark.range(600_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 50 == 1, -2).otherwise(F.col("id")).alias("k"), F.lit("x").alias("l"))
    hot = {r["_hot"]: r["_rows"] for r in hot_keys(table.repartition(40), ["k", "l"], 5_000).collect()}
    for key, n in ((-1, 200_000), (-2, 8_000)):
        h = spark.range(1).select(F.xxhash64(F.lit(key).cast("long"), F.lit("x"))).first()[0]
        assert n <= hot[h] <= n + 1_000


def test_a_fact_is_shuffled_once(spark):
    fact = spark.range(100_000).select((F.col("id") % 9).alias("k"), "id").repartition(4)
    plan = salted_join(fact, spark.range(5).select(F.col("id").alias("k")), ["k"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning(k#" in x and "_salt" not in x]


@pytest.mark.parametrize("times", ["one dated 1900", "all in one second", "half in one second", "even"])
def test_ranges_of_a_hot_key_are_even(spark, times):
    """20,000 rows of one key in 20 ranges: the largest holds at most twice the mean."""
    even = F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).cast("timestamp_ntz")
    same = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    when = {"one dated 1900": F.when(F.col("id") == 77, F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")).otherwise(even),
            "all in one second": same, "half in one second": F.when(F.col("id") % 2 == 0, same).otherwise(even), "even": even}[times]
    table = spark.range(20_000).select(F.when(F.col("id") % 1000 == 3, None).otherwise(1).alias("k"), when.alias("ts"), (F.col("id") * 7919 % 20_011).alias("tie"))
    cut = ordered_scan(table, ["k"], ["ts", "tie"], [Scan(previous={"p": "tie"})], 4000, "piece")
    sizes = [r["count"] for r in cut.filter("k = 1").groupBy("piece").count().collect()]
    assert 15 <= len(sizes) <= 21 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    w = Window.partitionBy("k").orderBy("ts", "tie")
    assert rows(cut, "k", "ts", "tie", "p") == rows(table.withColumn("p", F.lag("tie").over(w)))
    assert rows(cut.filter("k is null").select("piece").distinct()) == [(0,)]


@pytest.mark.parametrize("hot_rows", [1, 7, 60, 10_000_000])
@pytest.mark.parametrize("limit", ["1 second", "3 hours", "2 days"])
def test_sessions_of_a_hot_entity(events, hot_rows, limit):
    """One entity has a third of all events; runs go on across ranges."""
    found = windows.sessions(events, ["user_id"], "ts", limit, hot_rows)
    plain = events.filter("ts is not null").groupBy(F.session_window(F.col("ts").cast("timestamp"), limit).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"))
    assert rows(found, "user_id", "first_event", "last_event", "events") == rows(plain, "user_id", "first_event", "last_event", "events")


@pytest.mark.parametrize("hot_rows", [1, 25, 10_000_000])
def test_ties_of_a_hot_key(events, hot_rows):
    latest = events.withColumn("ts", F.when(F.col("user_id") == 7, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")))
    plain = latest.withColumn("rk", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("ts")))).filter("rk = 1").drop("rk")
    assert rows(windows.latest_ties(latest, ["user_id"], "ts", hot_rows)) == rows(plain)


@pytest.mark.parametrize("hot_rows", [1, 3, None])
def test_counters_with_missing_values(spark, hot_rows):
    listed = [(1, 1, 10, 5, "a"), (1, 2, None, 6, "a"), (1, 3, 17, None, "a"), (1, 4, 3, 9, "a"), (1, 5, None, None, "a"), (1, 6, 4, 1, "b"), (2, 1, None, None, "a"), (2, 2, 5, None, "a"), (2, 3, 9, 2, "a")]
    table = spark.createDataFrame(listed, "k int, t int, x int, y int, e string")
    found = windows.counter_delta(table, ["k"], "t", {"dx": "x", "dy": "y"}, "e", hot_rows=hot_rows)
    assert rows(found, "k", "t", "dx", "dy", "flag_restart") == [
        (1, 1, None, None, 0), (1, 2, None, 1, 0), (1, 3, 7, None, 0), (1, 4, 3, 9, 1), (1, 5, None, None, 0), (1, 6, 4, 1, 1), (2, 1, None, None, 0), (2, 2, None, None, 0), (2, 3, 4, None, 0)]


@pytest.mark.parametrize("hot_rows", [1, 20, 10_000_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(events, hot_rows, how):
    lookup = events.filter("user_id % 2 = 1 or user_id is null").groupBy("user_id").agg(F.max("value").alias("best"))
    plain = events.join(lookup, "user_id", how)
    assert rows(salted_join(events, lookup, ["user_id"], how, hot_rows), *plain.columns) == rows(plain)


@pytest.mark.parametrize("hot_rows", [1, 20, 10_000_000])
def test_group_attach_equals_window(events, hot_rows):
    w = Window.partitionBy("user_id", "event_type")
    plain = events.select("*", F.count(F.lit(1)).over(w).alias("n"), F.max("value").over(w).alias("m"))
    split = attach_group(events, ["user_id", "event_type"], {"n": F.count(F.lit(1)), "m": F.max("value")}, hot_rows)
    assert rows(split, *plain.columns) == rows(plain)


@pytest.mark.parametrize("hot_rows", [1, 30])
def test_operators_are_the_same_when_split(events, hot_rows):
    e = events.filter("ts is not null")
    assert rows(windows.gaps(e, ["user_id"], "ts", tie=["event_id"], hot_rows=hot_rows)) == rows(windows.gaps(e, ["user_id"], "ts", tie=["event_id"]))
    chain = e.withColumns({"kind": F.when(F.col("event_type") == "view", "L").when(F.col("event_type") == "signup", "D").otherwise("I"), "a": F.col("event_id"), "b": F.col("event_id") + 1,
                           "base": F.col("event_id") % 9, "model": F.when(F.col("value") > 50, "x").otherwise("y")})
    audit = lambda n: rows(windows.chain_audit(chain, ["user_id"], "kind", "ts", "a", "b", "base", "model", F.col("value") > 90, ["event_id"], hot_rows=n))
    assert audit(hot_rows) == audit(None)
    assert rows(windows.recurrence(e, ["user_id"], hot_rows)) == rows(windows.recurrence(e, ["user_id"]))
    other = e.filter("event_type = 'error'")
    assert rows(joins.has_match(e, other, ["user_id"], hot_rows)) == rows(joins.has_match(e, other, ["user_id"]))


def test_results_do_not_depend_on_partitions(events):
    e = events.filter("ts is not null")
    one = windows.gap_stats(windows.gaps(e.coalesce(1), ["user_id"], "ts", tie=["event_id"]), ["user_id"], "ts")
    many = windows.gap_stats(windows.gaps(e.repartition(13, "value"), ["user_id"], "ts", tie=["event_id"]), ["user_id"], "ts")
    assert rows(one) == rows(many)


def test_a_large_group_of_copies_gives_linear_output(spark):
    """1000 equal indexes on one table: 999 links, not half a million pairs."""
    copies = spark.range(1000).select(F.lit(1).alias("obj"), F.col("id").alias("idx"), F.lit(1).alias("ord"), F.lit("a").alias("col"))
    sig = signature(copies, ["obj", "idx"], ["ord"], "col")
    out = duplicate_pairs(sig, ["obj"], "idx")
    assert out.count() == 999
    star = joins.pairs(sig.withColumn("k", F.array_join("key_columns", ",")), ["obj"], "idx", ["k"])
    assert star.count() == 999 and star.first()["pair_count"] == 499_500
