"""Grouped reports over dates, numbers, texts, lists and settings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import band, flag
from fleetgauge.functions.numbers import int_div, pages_to_mb, percent, ratio, row_count, whole_ratio
from fleetgauge.functions.times import boundary_diff, instant, read_instant, unpack_datetime, unpack_duration
from fleetgauge.operators.skew import Scan, ordered_scan, salted_join, top_rows


def age_report(df: DataFrame, keys: Sequence[str], ts: str, as_of, unit: str, bands: Sequence[tuple[int, str]],
               default: str) -> DataFrame:
    """Age of each key's last event in boundaries crossed, with its band (age <= limit)."""
    age = boundary_diff(unit, F.col("last_event"), instant(as_of))
    return (df.groupBy(*keys).agg(F.max(ts).alias("last_event")).withColumn("age", age)
            .withColumn("age_band", band([(F.col("age") <= n, label) for n, label in bands], default)))


class PackedRuns(NamedTuple):
    runs: DataFrame
    per_day: DataFrame


def packed_runs(df: DataFrame, keys: Sequence[str], run_date: str, run_time: str, duration: str) -> PackedRuns:
    """Runs stored as packed whole numbers: decoded, and counted per key and day."""
    runs = df.withColumns({"run_at": unpack_datetime(F.col(run_date), F.col(run_time)),
                           "duration_sec": unpack_duration(F.col(duration))})
    per_day = (runs.groupBy(*keys, F.to_date("run_at").alias("run_day"))
               .agg(row_count().alias("runs"), F.sum("duration_sec").alias("seconds")))
    return PackedRuns(runs, per_day)


def ratio_report(df: DataFrame, keys: Sequence[str], num: Column, den: Column, zero: int | None = None,
                 scale: int = 2) -> DataFrame:
    """Guarded quotient and percent of two sums per group."""
    out = df.groupBy(*keys).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    return out.withColumns({"quotient": ratio(F.col("num"), F.col("den"), scale, zero=zero),
                            "pct": percent(F.col("num"), F.col("den"), scale, zero=zero)})


class FileInventory(NamedTuple):
    files: DataFrame
    totals: DataFrame


UNLIMITED = 268_435_456  # fixed value: the page count that stands for "no limit"


def file_inventory(df: DataFrame, size: str, max_size: str, growth: str, is_percent: Column, is_data: Column,
                   by: Sequence[str]) -> FileInventory:
    """Sizes in MB, growth as text, limit and growth flags; totals per database."""
    s, m, g = F.col(size).cast("bigint"), F.col(max_size).cast("bigint"), F.col(growth).cast("bigint")
    unlimited = m.isin(-1, UNLIMITED)
    files = df.withColumns({
        "size_mb": pages_to_mb(s),
        "max_size_mb": F.when(unlimited, F.lit(-1)).otherwise(pages_to_mb(m)).cast("bigint"),
        "growth_text": F.when(is_percent, F.concat(g.cast("string"), F.lit("%")))
                        .otherwise(F.concat(pages_to_mb(g).cast("string"), F.lit(" MB"))),
        "flag_unlimited": flag(unlimited),
        "flag_near_max": flag((m > 0) & ~unlimited & (s * 10 > m * 9)),
        "flag_small_growth": flag(~is_percent & is_data & (g > 0) & (pages_to_mb(g) < 128)),
        "flag_percent_growth": flag(is_percent),
    })
    flags = ["flag_unlimited", "flag_near_max", "flag_small_growth", "flag_percent_growth"]
    totals = files.groupBy(*by).agg(row_count().alias("files"), F.sum("size_mb").alias("size_mb"), *[F.sum(f).alias(f) for f in flags])
    return FileInventory(files, totals)


def catch_up(df: DataFrame, keys: Sequence[str], queue: Column, rate: Column, high: int = 1_048_576,
             warn: int | None = None, whole: bool = False) -> DataFrame:
    """Seconds until a queue is empty, NULL at rate 0, and the worst per group.

    `whole` divides whole numbers and drops the rest; otherwise one decimal is kept.
    """
    est = int_div(queue, rate).cast("decimal(18,1)") if whole else whole_ratio(queue, rate, 1)
    ladder = [(queue > high, 3)] + ([(queue > warn, 2)] if warn else []) + [((queue > 0) & (rate == 0), 1)]
    level = reduce(lambda acc, s: acc.when(*s), ladder[1:], F.when(*ladder[0])).otherwise(0)
    out = df.groupBy(*keys).agg(
        row_count().alias("rows"), F.max(F.when(rate > 0, est)).alias("worst_sec"), F.max(queue).alias("largest_queue"),
        F.sum(flag((queue > 0) & (rate == 0))).alias("stalled"), F.max(level).alias("_level"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("", "ZERO_RATE", "QUEUE_WARN", "QUEUE_HIGH")]), F.col("_level") + 1)
    return out.withColumn("queue_flag", names).drop("_level")


def progress(df: DataFrame, keys: Sequence[str], done: Column, total: Column) -> DataFrame:
    """Percent done and what remains per entity; 0 percent when there is nothing to do."""
    out = df.groupBy(*keys).agg(F.sum(done).alias("done"), F.sum(total).alias("total"))
    return out.withColumns({"percent_done": percent(F.col("done"), F.col("total"), 1, zero=0),
                            "remaining": F.col("total") - F.col("done")})


# Distance between allocation pages of each kind.
PFS_STRIDE, GAM_STRIDE = 8_088, 511_232


def contention_census(df: DataFrame, resource: str, wait: Column, by: Sequence[str] = ()) -> DataFrame:
    """Waits per kind of page. The resource is `database:file:page`; anything else is DATA_OR_OTHER."""
    page = F.expr(f"try_cast(split_part({resource}, ':', 3) as bigint)")
    at = lambda n, stride: (page == n) | ((page > n) & (F.try_mod(page - n, F.lit(stride)) == 0))
    kind = band([(at(1, PFS_STRIDE), "PFS"), (at(2, GAM_STRIDE), "GAM"), (at(3, GAM_STRIDE), "SGAM")], "DATA_OR_OTHER")
    out = df.groupBy(*by, kind.alias("page_class")).agg(row_count().alias("waits"), F.sum(wait).alias("wait_total"), F.max(wait).alias("wait_max"))
    return out.withColumn("flag_allocation_page", flag(F.col("page_class") != "DATA_OR_OTHER"))


def location_of(path: Column) -> Column:
    """Folder of a path: up to the last backslash, else up to the last slash, else all of it."""
    return (F.when(path.contains("\\"), F.regexp_extract(path, r"(?s)^(.*\\)", 1))
            .when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(path))


def location_census(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Paths and distinct paths per entity and folder."""
    per_path = df.groupBy(*keys, path).agg(row_count().alias("n"))
    return (per_path.groupBy(*keys, location_of(F.col(path)).alias("location"))
            .agg(F.sum("n").alias("uses"), row_count().alias("paths")))


def statement_census(df: DataFrame, text: str, start: Column, end: Column, cost: Column, by: Sequence[str] = ()) -> DataFrame:
    """Cost per distinct current statement, cut from the batch by byte offsets (two bytes a
    character, end -1 means to the end). Statements are grouped by their whole text."""
    from_char = F.floor(start / 2).cast("int") + 1
    stop = F.when(end == -1, F.length(text) * 2).otherwise(end)
    statement = F.substring(F.col(text), from_char, F.floor((stop - start) / 2).cast("int") + 1)
    return (df.groupBy(*by, statement.alias("statement"))
            .agg(row_count().alias("runs"), F.sum(cost).alias("total_cost"), F.max(cost).alias("max_cost")))


# Kinds of locked resources in a deadlock report.
LOCK_KINDS = ["keylock", "pagelock", "ridlock", "objectlock", "rowgrouplock", "hobtlock", "exchangeEvent", "metadatalock", "applicationlock"]


def xml_events(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event of an event document: time, victim, first object, process count.

    An event holds its victim and processes directly, or a whole deadlock report below
    `data/value`; a document is a list of events or a single one. Documents that are not
    well-formed give no rows, odd time stamps no time. With locks of several kinds the first
    object is that of the first kind in `LOCK_KINDS`.
    """
    locks = ", ".join(f"{kind} array<struct<_objectname string>>" for kind in LOCK_KINDS)
    report = (f"struct<`victim-list` struct<victimProcess array<struct<_id string>>>, `process-list` struct<process array<struct<_id string>>>, "
              f"`resource-list` struct<{locks}>>")
    shape = ("event array<struct<_name string, _timestamp string, victim struct<_id string>, "
             f"process array<struct<_id string, _object string>>, data array<struct<value struct<deadlock {report}>>>>>")
    text = F.col(column)
    single = text.rlike(r"^\s*(<\?xml[^>]*\?>)?\s*<event[\s>]")
    listed = F.when(single, F.concat(F.lit("<events>"), F.regexp_replace(text, r"^\s*<\?xml[^>]*\?>", ""), F.lit("</events>"))).otherwise(text)
    doc = F.from_xml(listed, shape, {"mode": "PERMISSIVE", "attributePrefix": "_"})
    event = df.select(*keep, F.explode(doc.getField("event")).alias("e"))
    one = lambda c: F.try_element_at(c, F.lit(1))
    event = event.withColumn("d", one(F.filter("e.data.value.deadlock", lambda x: x.isNotNull())))
    objects = [one(F.col(f"d.`resource-list`.{kind}")).getField("_objectname") for kind in LOCK_KINDS]
    return event.select(
        *keep, F.col("e._name").alias("event_name"),
        read_instant(F.col("e._timestamp")).alias("event_time"),
        F.coalesce("e.victim._id", one(F.col("d.`victim-list`.victimProcess")).getField("_id")).alias("victim"),
        F.coalesce(one(F.col("e.process")).getField("_object"), *objects).alias("first_object"),
        F.coalesce(F.size("e.process"), F.size("d.`process-list`.process"), F.lit(0)).alias("processes"))


def memberships(df: DataFrame, keys: Sequence[str], role: str, watched: str, out: str = "flag_member") -> DataFrame:
    """Sorted role list per principal and whether it holds a given role."""
    roles = df.select(*keys, role).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(role)).alias("_r"))
    return roles.select(*keys, F.array_join("_r", ",").alias("roles"), F.size("_r").alias("role_count"),
                        flag(F.array_contains("_r", watched)).alias(out))


def route_list(df: DataFrame, keys: Sequence[str], priority: Sequence[str], name: str, sep: str = " -> ") -> DataFrame:
    """Names per key in order of priority, as one text. A routing list is short by nature."""
    items = F.array_sort(F.collect_list(F.struct(*priority, F.col(name).cast("string").alias("_t"))))
    return df.groupBy(*keys).agg(items.alias("_l")).select(*keys, F.array_join(F.col("_l._t"), sep).alias("route"),
                                                          F.size("_l").alias("hops"))


def pivot_settings(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Name/value rows to one column per named setting."""
    return df.filter(F.col(name).isin(*names)).groupBy(*keys).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def overrides(local: DataFrame, general: DataFrame, keys: Sequence[str], value: str, default: str) -> DataFrame:
    """Local settings beside the general one, flagged when set (not 0) and different."""
    rows = salted_join(local, general, keys, "left")
    return rows.withColumn("flag_override", flag((F.col(value) != 0) & (F.col(value) != F.col(default))))


class Drift(NamedTuple):
    latest: DataFrame
    changes: DataFrame
    outliers: DataFrame


def inventory_drift(df: DataFrame, server: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str] = (),
                    hot_rows: int | None = None) -> Drift:
    """Latest snapshot per server; values that changed against the snapshot before; values of
    the latest snapshot unlike the fleet's most common one (the smallest of equally common)."""
    order = [F.desc(c) for c in [ts, *tie]]
    newest = top_rows(df.select(*server, ts, *tie, *columns), server, order, 1).drop("rn", *tie)
    scanned = ordered_scan(df.select(*server, ts, *tie, *columns, F.lit(True).alias("_seen")), server, [ts, *tie],
                           [Scan(previous={"_had": "_seen", **{f"_p_{c}": c for c in columns}})], hot_rows)
    long = lambda frame, before: frame.select(*server, ts, F.explode(F.array(*[
        F.struct(F.lit(c).alias("setting"), F.col(c).cast("string").alias("value"),
                 (F.col(f"_p_{c}").cast("string") if before else F.lit(None).cast("string")).alias("previous"))
        for c in columns])).alias("x")).select(*server, ts, "x.*")
    changes = long(scanned.filter("_had"), True).filter(~F.col("value").eqNullSafe(F.col("previous")))
    current = long(newest, False).drop("previous")
    common = top_rows(current.groupBy("setting", "value").agg(row_count().alias("n")), ["setting"],
                      [F.desc("n"), F.asc_nulls_first("value")], 1).select("setting", F.col("value").alias("fleet_value"))
    outliers = current.join(common, "setting").filter(~F.col("value").eqNullSafe(F.col("fleet_value")))
    return Drift(newest, changes, outliers)
