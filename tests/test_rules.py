"""Hand-written rows at the edges of each rule."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import int_div, percent, ratio, whole_ratio
from fleetgauge.functions.times import boundary_diff, unpack_datetime, unpack_duration
from fleetgauge.functions.labels import band, like_any
from fleetgauge.operators import aggregates, overlap, reporting, rules, windows
from fleetgauge.plans import findings, reports
from fleetgauge.sources import sections
from fleetgauge.sources.schemas import LANDING, landing_schema
from tests.conftest import rows

NOW = "2024-03-01 12:00:00"


def ts(text):
    return dt.datetime.fromisoformat(text)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("unit, start, end, want", [
    ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:01", 1), ("minute", "2024-01-01 00:01:00", "2024-01-01 00:01:59", 0),
    ("hour", "2024-01-01 00:59:59", "2024-01-01 01:00:00", 1), ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
    ("second", "2024-01-01 00:00:00.900", "2024-01-01 00:00:01.100", 1), ("minute", "2024-01-01 00:01:01", "2024-01-01 00:00:59", -1),
    ("day", "1969-12-31 23:00:00", "1970-01-01 01:00:00", 1)])
def test_differences_count_boundaries(spark, unit, start, end, want):
    assert one(spark, d=boundary_diff(unit, ntz(start), ntz(end))).d == want


def test_packed_times(spark):
    got = one(spark, a=unpack_datetime(F.lit(20240131), F.lit(93005)), b=unpack_datetime(F.lit(0), F.lit(0)),
              c=unpack_duration(F.lit(10203)), d=unpack_duration(F.lit(0)), e=unpack_duration(F.lit(1000000)))
    assert got.a == ts("2024-01-31 09:30:05") and got.b is None and (got.c, got.d, got.e) == (3723, 0, 360000)


def test_ratios_round_half_up_exactly(spark):
    got = one(spark, a=ratio(F.lit(1), F.lit(8)), b=percent(F.lit(1), F.lit(0)), c=percent(F.lit(1), F.lit(0), zero=0),
              d=ratio(F.lit(-1), F.lit(8)), e=ratio(F.lit(9259059), F.lit(1463108), 4), f=int_div(F.lit(-7), F.lit(2)), g=int_div(F.lit(7), F.lit(0)))
    assert (got.a, got.b, got.c, got.d, got.e, got.f, got.g) == (Decimal("0.13"), None, 0, Decimal("-0.13"), Decimal("6.3283"), -3, None)


@pytest.mark.parametrize("n, d", [(1, 8), (-1, 8), (7, -3), (0, 5), (5, 0), (10**17, 3), (None, 2), (2**62, 7), (999, 1000)])
def test_whole_ratio_equals_ratio(spark, n, d):
    num, den = F.lit(n).cast("bigint"), F.lit(d).cast("bigint")
    got = one(spark, a=whole_ratio(num, den, 1), b=ratio(num, den, 1))
    assert got.a == got.b


def test_like_keeps_wildcard_underscore_and_plain_backslash(spark):
    got = one(spark, a=like_any(F.lit("SLEEPX_TASK"), ["SLEEP_%"]), b=like_any(F.lit("SLEEP"), ["SLEEP_%"]),
              c=like_any(F.lit("NT SERVICE\\sql"), ["NT SERVICE\\%"]), d=like_any(F.lit("sVc_x"), ["%SVC%"], True))
    assert (got.a, got.b, got.c, got.d) == (True, False, True, True)


def test_ladders_take_the_first_match(spark):
    d = lambda days: ntz(NOW) + F.expr(f"INTERVAL {days} DAYS")
    labels = [one(spark, x=band(rules.expiry_ladder(d(n), NOW), "OK")).x for n in (-1, 0, 29, 30, 89, 90, 179, 180)]
    assert labels == ["EXPIRED", "CRITICAL", "CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", "OK"]
    assert one(spark, x=band(rules.expiry_ladder(F.lit(None).cast("timestamp_ntz"), NOW), "OK")).x == "N/A"
    ratings = [one(spark, x=band(rules.segment_ladder(F.lit(n)), "Critical")).x for n in (-1, 99, 100, 500, 1000)]
    assert ratings == ["CollectionError", "OK", "Moderate", "High", "Critical"]
    last = lambda h: ntz(NOW) - F.expr(f"INTERVAL {h} HOURS")
    assert [one(spark, x=band(rules.log_backup_ladder(last(h), NOW), "OK")).x for h in (1, 2, 24, 25)] == ["OK", "NO_BACKUP_LAST_1H", "NO_BACKUP_LAST_1H", "NO_BACKUP_LAST_24H"]


def test_wait_profile(spark):
    waits = spark.createDataFrame([
        ("WAITFOR", 1, 100, 0, 5), ("SLEEPX_TASK", 1, 100, 0, 5), ("SOS_SCHEDULER_YIELD", 0, 50, 10, 5), ("THREADPOOL", 2, 10, 0, 5),
        ("PAGEIOLATCH_SH", 3, 20, 14, 9), ("PAGEIOLATCH_EX", 3, 20, 15, 9), ("LCK_M_X", 1, 0, 0, 0), ("BACKUPIO", 1, 80, 0, 5), ("HADR_SYNC", 1, 20, 0, 1)],
        "w string, n bigint, t bigint, s bigint, m bigint")
    got = {r.w: r for r in reports.wait_profile(waits, "w", "n", "t", "s", "m").collect()}
    assert set(got) == {"SOS_SCHEDULER_YIELD", "THREADPOOL", "PAGEIOLATCH_SH", "PAGEIOLATCH_EX", "BACKUPIO", "HADR_SYNC"}
    assert got["THREADPOOL"].category == "CPU"  # never WORKER_THREAD
    assert got["PAGEIOLATCH_SH"].category == "IO" and got["PAGEIOLATCH_EX"].category == "CPU"  # 70 % is not above 70 %
    assert got["SOS_SCHEDULER_YIELD"].mean_wait == 0 and got["BACKUPIO"].share_pct == Decimal("40.00")
    assert got["HADR_SYNC"].category == "AG" and got["PAGEIOLATCH_SH"].resource == 6


BACKUPS = "db string, kind string, start timestamp_ntz, finish timestamp_ntz, first bigint, last bigint, base bigint, model string, copy boolean, id bigint"


def backups(spark, *items):
    return spark.createDataFrame([(d, k, ts(s), ts(f), a, b, c, m, cp, i) for i, (d, k, s, f, a, b, c, m, cp) in enumerate(items)], BACKUPS)


def test_chain_audit(spark):
    h = backups(
        spark,
        ("a", "D", "2024-02-10 00:00", "2024-02-10 01:00", 0, 100, None, "FULL", False),
        ("a", "L", "2024-02-10 02:00", "2024-02-10 02:01", 100, 110, None, "FULL", False),   # first log: no previous one
        ("a", "D", "2024-02-10 03:00", "2024-02-10 04:00", 0, 200, None, "FULL", True),      # copy-only
        ("a", "L", "2024-02-10 05:00", "2024-02-10 05:01", 110, 120, None, "FULL", False),   # follows on
        ("a", "I", "2024-02-10 06:00", "2024-02-10 06:01", 0, 130, 100, "FULL", False),      # right base, copy-only left aside
        ("a", "L", "2024-02-10 07:00", "2024-02-10 07:01", 125, 140, None, "SIMPLE", False), # break and change
        ("a", "I", "2024-02-10 08:00", "2024-02-10 08:01", 0, 150, 90, "SIMPLE", False),     # wrong base
        ("b", "I", "2024-02-10 08:00", "2024-02-10 08:01", 0, 150, 90, "FULL", False),       # no base known: not reported
        ("b", "L", "2024-02-10 09:00", "2024-02-10 09:01", 1, 2, None, "FULL", False))
    got = windows.chain_audit(h, ["db"], "kind", "start", "first", "last", "base", "model", F.col("copy"), ["id"])
    assert rows(got, "id", "anomaly") == [(2, "COPY_ONLY_FULL"), (5, "ATTRIBUTE_CHANGE"), (5, "SEQUENCE_GAP"), (6, "BASE_MISMATCH")]


def test_coverage_keeps_ties_and_missing_databases(spark):
    dbs = spark.createDataFrame([("a", "FULL"), ("b", "FULL"), ("c", "SIMPLE")], "db string, model string")
    h = backups(spark, ("a", "D", "2024-02-10 00:00", "2024-02-10 01:00", 0, 1, None, "FULL", False), ("a", "D", "2024-02-10 00:30", "2024-02-10 01:00", 0, 2, None, "FULL", False),
                ("a", "L", "2024-03-01 11:00", "2024-03-01 12:00", 0, 1, None, "FULL", False), ("b", "L", "2024-02-29 11:00", "2024-02-29 11:59", 0, 1, None, "FULL", False))
    got = rows(reports.backup_coverage(dbs, h, ["db"], "kind", "finish", "model", NOW), "db", "flag_no_backup", "flag_no_recent_log")
    assert got == [("a", 0, 0), ("a", 0, 0), ("b", 1, 1), ("c", 1, 0)]


def test_single_event_leaves_no_interval(spark):
    dbs = spark.createDataFrame([("a", "FULL"), ("b", "FULL"), ("c", "SIMPLE")], "db string, model string")
    h = backups(spark, ("a", "L", "2024-03-01 10:00", "2024-03-01 10:00", 0, 1, None, "FULL", False), ("b", "L", "2024-03-01 11:00", "2024-03-01 11:00", 0, 1, None, "FULL", False),
                ("b", "L", "2024-03-01 11:30", "2024-03-01 11:30", 0, 1, None, "FULL", False))
    stats = windows.gap_stats(windows.gaps(h, ["db"], "finish", tie=["id"]), ["db"], "finish")
    got = rows(windows.exposure(dbs, stats, ["db"], NOW, "model"), "db", "events", "flag_exposed", "flag_no_event")
    assert got == [("a", None, 1, 1), ("b", 1, 0, 0), ("c", None, 0, 0)]
    counted = rows(windows.gap_stats(windows.gaps(h, ["db"], "finish", tie=["id"]), ["db"], "finish", count_first=True), "db", "events")
    assert counted == [("a", 1), ("b", 2)]


def test_regression_edges(spark):
    runs = spark.createDataFrame([("twice", 1, 10.0), ("twice", 2, 20.0), ("more", 1, 10.0), ("more", 2, 20.1), ("zero", 1, 0.0), ("zero", 2, 9.0), ("one", 1, 5.0)],
                                 "q string, t bigint, v double")
    assert rows(windows.regressions(runs, ["q"], [F.desc("t")], "v"), "q") == [("more",)]


def test_counter_restart(spark):
    c = spark.createDataFrame([("s", 1, 10, "x"), ("s", 2, 15, "x"), ("s", 3, 4, "x"), ("s", 4, 50, "y"), ("s", 5, 50, "y")], "k string, t bigint, c bigint, boot string")
    got = rows(windows.counter_delta(c, ["k"], "t", {"d": "c"}, "boot"), "t", "d", "flag_restart")
    assert got == [(1, None, 0), (2, 5, 0), (3, 4, 1), (4, 50, 1), (5, 0, 0)]


def indexes(spark, *items):
    """(index, key columns, included columns, filter)"""
    flat = [(1, i, n, c, inc, f) for i, keys, incs, f in items for inc, cols in ((False, keys), (True, incs)) for n, c in enumerate(cols)]
    return spark.createDataFrame(flat, "obj int, idx int, ord int, col string, inc boolean, flt string")


def test_duplicate_indexes(spark):
    df = indexes(spark, (1, ["a", "b"], ["x"], None), (2, ["a", "b"], ["x"], None), (3, ["a", "b"], ["y"], None), (4, ["a"], [], None), (5, ["ab"], [], None), (6, ["a"], [], "p=1"), (7, ["a", "b", "c"], [], None))
    sig = overlap.signature(df, ["obj", "idx"], ["ord"], "col", included=F.col("inc"), keep=["flt"])
    got = rows(overlap.duplicate_pairs(sig, ["obj"], "idx", "flt"), "index_1", "index_2", "duplicate_type", "set_size")
    assert got == [(1, 2, "EXACT_DUPLICATE", 2), (1, 4, "INDEX2_IS_PREFIX", 2), (1, 7, "INDEX1_IS_PREFIX", 3), (2, 4, "INDEX2_IS_PREFIX", 2),
                   (3, 4, "INDEX2_IS_PREFIX", 2), (4, 7, "INDEX1_IS_PREFIX", 2)]


def test_overlapping_statistics_have_no_separator(spark):
    df = indexes(spark, (1, ["a"], [], None), (2, ["ab"], [], None), (3, ["a", "b"], [], None), (4, ["a"], [], None), (5, ["a"], [], "p=1"))
    sig = overlap.signature(df, ["obj", "idx"], ["ord"], "col", keep=["flt"])
    got = rows(overlap.overlapping_stats(sig, ["obj"], "idx", "flt"), "stat_1", "stat_2", "duplicate_type")
    assert got == [(1, 2, "OVERLAPPING_PREFIX"), (1, 3, "OVERLAPPING_PREFIX"), (1, 4, "EXACT_DUPLICATE"), (1, 5, "OVERLAPPING_PREFIX")]


def test_key_comparison_kinds(spark):
    wanted = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"])], "obj int, keys array<string>")
    existing = spark.createDataFrame([(1, ["a", "b", "c"], "i1"), (1, ["a", "b"], "i2"), (1, ["a", "b", "c", "d"], "i3"), (1, ["a"], "i4"), (1, ["a", "x"], "i5"), (1, ["a", "b", "x"], "i6"), (1, ["q"], "i7"), (2, ["y"], "i8")],
                                     "obj int, keys array<string>, index_name string")
    cmp = overlap.compare_keys(wanted, existing, ["obj"])
    assert rows(cmp, "match_type", "prefix_length", "indexes", "first_index") == [
        ("EXACT_KEY_MATCH", 3, 1, "i1"), ("EXISTING_IS_PREFIX_OF_MISSING", 1, 1, "i4"), ("EXISTING_IS_PREFIX_OF_MISSING", 2, 1, "i2"),
        ("MISSING_IS_PREFIX_OF_EXISTING", 3, 1, "i3"), ("PARTIAL_LEADING_MATCH", 2, 1, "i6"), ("SAME_FIRST_KEY_ONLY", 1, 1, "i5")]
    existing = existing.union(spark.createDataFrame([(1, ["a", "y"], "i9")], existing.schema)).withColumns({"kind": F.when(F.col("index_name") == "i1", "UQ"), "listed": F.concat(F.lit(" ("), F.array_join("keys", ","), F.lit(")"))})
    matches = overlap.matching_indexes(wanted, existing, ["obj"], carry=["kind", "listed"])
    text = dict(rows(overlap.evidence_text(wanted, matches, ["obj"], details=F.col("kind"), tail=F.col("listed")), "obj", "evidence"))
    assert text[2] == "[no relevant leading-key overlap]"
    assert text[1].split(" | ") == [
        "i1 [EXACT_KEY_MATCH; UQ; prefix=3] (a,b,c)", "i3 [MISSING_IS_PREFIX_OF_EXISTING; prefix=3] (a,b,c,d)", "i2 [EXISTING_IS_PREFIX_OF_MISSING; prefix=2] (a,b)",
        "i4 [EXISTING_IS_PREFIX_OF_MISSING; prefix=1] (a)", "i6 [PARTIAL_LEADING_MATCH; prefix=2] (a,b,x)", "i5 [SAME_FIRST_KEY_ONLY; prefix=1] (a,x)", "i9 [SAME_FIRST_KEY_ONLY; prefix=1] (a,y)"]
    with pytest.raises(Exception, match="more than 3 indexes"):
        overlap.evidence_text(wanted, matches, ["obj"], most=3).collect()


def test_job_reliability(spark):
    jobs = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job string")
    h = spark.createDataFrame([("j1", ts("2024-02-01 01:00"), 1, 10), ("j1", ts("2024-02-02 01:00"), 0, 0), ("j1", ts("2024-02-02 01:00"), 1, 100), ("j2", ts("2024-02-02 01:00"), 0, 3723), ("j3", ts("2023-01-01 01:00"), 1, 1)],
                              "job string, at timestamp_ntz, status int, sec bigint")
    got = rows(reports.job_reliability(jobs, h, ["job"], "at", "status", F.col("sec"), NOW), "job", "total_runs", "failure_ratio_pct", "last_status", "flag_last_failed", "flag_no_success", "flag_no_history", "flag_high_failure", "flag_duration")
    assert got == [("j1", 3, Decimal("33.33"), 1, 0, 0, 0, 1, 0), ("j2", 1, Decimal("100.00"), 0, 1, 1, 0, 1, 0), ("j3", 0, Decimal("0.00"), None, 0, 0, 1, 0, 0)]


def test_silent_failure(spark):
    runs = spark.createDataFrame([("j", "2024-02-01", 1), ("k", "2024-02-01", 0)], "job string, day string, status int")
    steps = spark.createDataFrame([("j", "2024-02-01", 0), ("j", "2024-02-02", 0), ("k", "2024-02-01", 0), ("j", "2024-02-01", 1)], "job string, day string, status int")
    assert rows(reports.silent_failures(steps, runs, ["job"], "day", F.col("status") == 0, F.col("status") == 1), "job", "day") == [("j", "2024-02-01")]


def test_quarantine_and_marker(spark):
    df = spark.createDataFrame([(1, "ok"), (-1, "ok"), (2, "ERROR: x"), (None, None)], "n int, t string")
    split = sections.split_failures(df, ["n"], ["t"])
    assert rows(split.good) == [(1, "ok"), (None, None)] and rows(split.failed) == [(-1, "ok"), (2, "ERROR: x")]
    assert sections.with_empty_marker(df).count() == 4
    assert rows(sections.with_empty_marker(df.filter("n = 9")), "n", "Note") == [(None, "No data returned")]


def test_run_log(spark):
    lines = spark.createDataFrame([("[2026-07-20T14:30:22Z] [OK]    [13_backup] [13_01] Exported 42 rows → a.csv",), ("[2026-07-20T14:30:25Z] [ERROR] [13_backup] [13_02] login [x] failed",),
                                   ("[2026-07-20T14:30:27Z] [SKIP]  [19_groups] [19_01] not enabled",), ("garbage",), ("[2026-07-20T14:31:00Z] [TIMEOUT] [09_q] [] killed",)], "value string")
    log = sections.parse_run_log(lines)
    assert rows(log, "status", "section", "rows_exported") == [("ERROR", "13_02", None), ("OK", "13_01", 42), ("SKIP", "19_01", None), ("TIMEOUT", "", None)]
    assert rows(findings.run_summary(log), "chapter", "sections_run", "sections_failed", "chapter_status") == [("09_q", 0, 0, "TIMEOUT"), ("13_backup", 2, 1, "PARTIAL"), ("19_groups", 0, 0, "SKIP")]


def test_findings_take_numbers_and_texts(spark):
    df = spark.createDataFrame([(1, 1, "", "OK"), (2, 0, "OVERDUE", "LOW"), (3, None, None, "OK")], "id int, flag_a int, check_flag string, SpaceFlag string")
    assert rows(findings.findings(df, "c", ["id"])) == [("c", "1", "flag_a", "1"), ("c", "2", "SpaceFlag", "LOW"), ("c", "2", "check_flag", "OVERDUE")]


def test_null_conditions_give_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert rows(rules.apply_rules(df, {"flag_x": F.col("v") > 3}, ["id"]).counts) == [(1, 1, 0), (2, 1, 1)]


def test_damage_and_owner(spark):
    pages = spark.createDataFrame([(1, 2, ts("2024-02-01")), (5, 1, ts("2024-01-01")), (6, 1, ts("2023-01-01"))], "e int, n int, at timestamp_ntz")
    assert rows(reports.damage_report(pages, "e", "n", "at", NOW), "resolution", "recurring_flag", "recent_flag") == [
        ("RESOLVED", "", ""), ("UNKNOWN", "", ""), ("UNRESOLVED", "RECURRING_ERRORS", "RECENT_EVENT")]
    owners = spark.createDataFrame([("SA",), (None,), ("NT SERVICE\\x",), ("anna",), ("sqlsvc",)], "o string")
    assert rows(rules.owner_class(owners, "o")) == [("NT SERVICE\\x", 0), ("SA", 0), ("anna", 1), ("sqlsvc", 0), (None, 1)]


def test_broken_markup_is_left_out(spark):
    docs = spark.createDataFrame([("<r><event name='a' timestamp='2024-01-01T00:00:01'><victim id='v'/><process id='p' object='o'/></event></r>",), ("<r><event",), (None,), ("<r></r>",)], "x string")
    assert rows(reporting.xml_events(docs, "x"), "event_name", "victim", "first_object", "processes") == [("a", "v", "o", 1)]


def test_page_classes(spark):
    df = spark.createDataFrame([("2:1:1",), ("2:1:8089",), ("2:1:2",), ("2:1:511234",), ("2:1:3",), ("2:1:511235",), ("2:1:x",), ("x",), ("2:1:9",)], "r string")
    assert rows(reporting.contention_census(df, "r", F.lit(1)), "page_class", "waits") == [("DATA_OR_OTHER", 3), ("GAM", 2), ("PFS", 2), ("SGAM", 2)]


def test_storage_rollup_counts_base_rows_only(spark):
    df = spark.createDataFrame([("t", 1, 100, 10, 8), ("t", 2, 100, 5, 4)], "t string, i int, r bigint, tp bigint, dp bigint")
    assert rows(aggregates.size_rollup(df, ["t"], F.col("i"), F.col("r"), F.col("tp"), F.col("dp"))) == [("t", 100, 120, 64, 56, "NONCLUSTERED")]


def test_landing_schemas_parse():
    for table in LANDING:
        assert "sql_instance" in landing_schema(table).names


def test_odd_times_in_a_run_log_do_not_end_the_job(spark):
    stamps = ["2024-01-01T10:00:00Z", "2024-01-01 10:00:00", "2024-01-01T10:00:00.5Z", "yesterday", "2024-13-01T10:00:00Z"]
    lines = spark.createDataFrame([(f"[{t}] [ok] [01] [01_01] Exported 3 rows",) for t in stamps], "value string")
    got = [r.logged_at for r in sections.parse_run_log(lines).collect()]
    assert [g is None for g in got] == [False, False, False, True, True] and got[0] == got[1]


def test_deadlock_reports_below_their_event(spark):
    report = ('<event name="xml_deadlock_report" timestamp="2024-01-01T10:00:00.123Z"><data name="xml_report"><value><deadlock><victim-list><victimProcess id="p1"/></victim-list>'
              '<process-list><process id="p1"><executionStack/></process><process id="p2"/></process-list>'
              '<resource-list><keylock objectname="a.b.c"/><pagelock objectname="x"/></resource-list></deadlock></value></data></event>')
    docs = spark.createDataFrame([(1, report), (2, f"<r>{report}{report}</r>"), (3, f'<?xml version="1.0"?>{report}'), (4, "<event"), (5, None)], "k int, x string")
    got = rows(reporting.xml_events(docs, "x", ["k"]), "k", "victim", "first_object", "processes")
    assert got == [(k, "p1", "a.b.c", 2) for k in (1, 2, 2, 3)]


def test_two_hundred_keywords_in_one_pass(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc /(.") for _ in range(rng.randint(1, 6))).strip() or "x"
    table = [(w, f"class {i % 17}", reports.SEVERITIES[i % 3]) for i, w in enumerate(dict.fromkeys(word() for _ in range(260)))][:200]
    listed = [(i, "".join(rng.choice("ABCabc /(.zz") for _ in range(rng.randint(0, 12)))) for i in range(300)]
    lines = spark.createDataFrame(listed, "n int, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    found = rows(reports.log_errors(lines, "ts", "text", "2024-01-05 00:00:00", ["n"], table), "n", "error_class", "severity", "days_ago")
    want = []
    for n, text in listed:
        hits = [(w, c, s) for w, c, s in table if w in text.lower()]
        if hits:
            want.append((n, hits[0][1], min((s for _, _, s in hits), key=reports.SEVERITIES.index), 4))
    assert found == sorted(want, key=repr) and len(want) > 50


def test_distinct_numbers_merge(spark):
    table = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") * 31) % 100_003 - 500).alias("n"))
    whole = aggregates.number_sets(table, ["k"], "n")
    halves = aggregates.number_sets(table.filter("n < 40000"), ["k"], "n").union(aggregates.number_sets(table.filter("n > 30000"), ["k"], "n"))
    exact = rows(table.groupBy("k").agg(F.countDistinct("n").alias("d")))
    assert rows(aggregates.count_numbers(whole, ["k"])) == rows(aggregates.count_numbers(aggregates.merge_number_sets(halves, ["k"]), ["k"])) == exact
    assert "Expand" not in whole._jdf.queryExecution().executedPlan().toString()
