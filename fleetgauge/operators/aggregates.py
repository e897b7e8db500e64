"""Aggregation jobs. Sums run over decimals or whole numbers, so partial sums are exact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import band, flag
from fleetgauge.functions.numbers import exact, int_div, percent, ratio, row_count
from fleetgauge.functions.times import before
from fleetgauge.operators.joins import attach_scalar
from fleetgauge.operators.skew import attach_group, top_rows


def count_if(cond: Column) -> Column:
    return F.sum(flag(cond))


def status_counts(df: DataFrame, keys: Sequence[str], status: str, codes: Mapping[str, object],
                  failed: str) -> DataFrame:
    """Runs per status and the failure share in percent."""
    counted = df.groupBy(*keys).agg(
        row_count().alias("total_runs"), *[count_if(F.col(status) == v).alias(n) for n, v in codes.items()])
    return counted.withColumn("failure_ratio_pct", percent(F.col(failed), F.col("total_runs")))


def age_buckets(df: DataFrame, keys: Sequence[str], ts: str, as_of, edges: Sequence[int] = (7, 30, 90),
                excess: int = 100) -> DataFrame:
    """Rows per age bucket; the flag says that the newest bucket holds more than `excess`."""
    t = F.col(ts)
    marks = [before(as_of, days=d) for d in edges]
    names = [f"last_{edges[0]}d"] + [f"day_{a + 1}_to_{b}" for a, b in zip(edges, edges[1:])] + [f"day_{edges[-1] + 1}_plus"]
    conds = [t >= marks[0]] + [(t < a) & (t >= b) for a, b in zip(marks, marks[1:])] + [t < marks[-1]]
    out = df.groupBy(*keys).agg(*[count_if(c).alias(n) for n, c in zip(names, conds)], row_count().alias("total"))
    return out.withColumn("flag_excessive", flag(F.col(names[0]) > excess))


def total_row(df: DataFrame, tasks: Column, total: Column, signal: Column, longest: Column,
              label: str = "INSTANCE_TOTAL", by: Sequence[str] = ()) -> DataFrame:
    """One summary row over everything (or per server)."""
    agg = df.filter(total > 0).groupBy(*by).agg(
        F.sum(tasks).alias("tasks"), F.sum(total).alias("total"), F.sum(signal).alias("signal"),
        F.sum(total - signal).alias("resource"), F.max(longest).alias("longest"))
    return agg.withColumns({"label": F.lit(label), "mean": ratio(F.col("total"), F.col("tasks"), zero=0)})


def with_total(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Groups and a total row with NULL keys; the total is taken from the groups. With `by` one
    total row for each of its groups."""
    keys = [*by, *keys]
    details = df.groupBy(*keys).agg(row_count().alias("rows"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return (details.groupingSets([keys, list(by)], *keys)
            .agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in (sums or {})]))


def hour_of(ts: Column) -> Column:
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def hourly(df: DataFrame, ts: str, as_of, total: Column, runs: Column, hours: int = 24,
           newest: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Activity per hour, the newest hours only. The mean per run divides whole numbers row by row first.

    `newest` hours in all, or with `by` (say, the server) for each group.
    """
    per_hour = (df.filter(F.col(ts) >= before(as_of, hours=hours))
            .groupBy(*by, hour_of(F.col(ts)).alias("hour"))
            .agg(row_count().alias("entries"), F.sum(total).alias("total"), F.sum(runs).alias("runs"),
                 ratio(F.sum(int_div(total, runs)), F.count(int_div(total, runs))).alias("mean_per_run")))
    return top_rows(per_hour, by, [F.desc("hour")], newest) if by else per_hour.orderBy(F.desc("hour")).limit(newest)


def category_impact(df: DataFrame, category: str, total: Column, plan: str, query: str) -> DataFrame:
    """Totals and exact distinct plans and queries per category; reduced before the distinct counts."""
    reduced = (df.filter(total > 0).groupBy(category, plan, query)
               .agg(F.sum(total).alias("t"), row_count().alias("n")))
    return reduced.groupBy(category).agg(
        F.sum("t").alias("total"), ratio(F.sum("t"), F.sum("n")).alias("mean"),
        F.countDistinct(plan).alias("plans"), F.countDistinct(query).alias("queries"))


def number_sets(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The different numbers of a whole-number column per group, as bitmaps of 32,768 numbers: `part` (of the number
    range) and `bits`. Meant for dense numbers: a part takes 4 KB however few of its numbers occur.

    A large group is spread over its parts, and a part is filled where its rows are read.
    """
    n = F.col(column).cast("bigint")
    rows = df.filter(n.isNotNull()).select(*by, F.bitmap_bucket_number(n).alias("part"), F.bitmap_bit_position(n).alias("_bit"))
    return rows.groupBy(*by, "part").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merge_number_sets(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Several tables of `number_sets` (of days, of servers) as one."""
    return sets.groupBy(*by, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_numbers(sets: DataFrame, by: Sequence[str], out: str = "different") -> DataFrame:
    """Exact number of different numbers per group."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(out))


def weighted_stats(df: DataFrame, keys: Sequence[str], mean: Column, runs: Column, largest: Column,
                   limit: int = 131_072) -> DataFrame:
    """Run-weighted mean, estimated total and maximum."""
    m, n = exact(mean, 4), runs.cast("decimal(18,0)")
    agg = df.filter(mean > 0).groupBy(*keys).agg(
        F.sum(n).cast("bigint").alias("runs"), F.sum(m * n).alias("_t"), F.max(largest).alias("largest"))
    return agg.select(*keys, "runs", ratio(F.col("_t"), F.col("runs")).alias("weighted_mean"),
                      F.col("_t").cast("decimal(38,2)").alias("estimated_total"), "largest",
                      flag(F.col("largest") >= limit).alias("flag_large"))


def variant_spread(df: DataFrame, keys: Sequence[str], variant: str, metric: Column, ts: str | None = None,
                   as_of=None, days: int = 30, top: int | None = None) -> DataFrame:
    """Groups with several variants: best, worst and their quotient."""
    rows = df if ts is None else df.filter(F.col(ts) >= before(as_of, days=days))
    small = rows.groupBy(*keys, variant).agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    out = (small.groupBy(*keys).agg(row_count().alias("variants"), F.min("lo").alias("best"), F.max("hi").alias("worst"))
           .filter(F.col("variants") > 1)
           .withColumn("worst_to_best", ratio(F.col("worst"), F.col("best"), 4)))
    return out if top is None else out.orderBy(F.desc_nulls_last("worst_to_best"), *keys).limit(top)


def repeated_small(df: DataFrame, keys: Sequence[str], size: Column, ts: str, many: int = 5,
                   small: int = 64) -> DataFrame:
    """Groups with several events: size range, time range, many-and-small flag."""
    out = (df.groupBy(*keys).agg(row_count().alias("events"), F.min(size).alias("smallest"), F.max(size).alias("largest"),
                                 F.sum(size).alias("_sum"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event"))
           .filter(F.col("events") > 1))
    return (out.withColumns({"mean": ratio(F.col("_sum"), F.col("events")),
                             "flag_repeated_small": flag((F.col("events") > many) & (F.col("largest") < small))})
            .drop("_sum"))


def size_rollup(df: DataFrame, keys: Sequence[str], index_id: Column, rows: Column, total_pages: Column,
                data_pages: Column) -> DataFrame:
    """Rows and KB per table; base structures (index 0 or 1) hold rows and data."""
    base = index_id.isin(0, 1)
    total = F.sum(total_pages)
    data = F.sum(F.when(base, data_pages).otherwise(0))
    kind = F.when(index_id == 0, "HEAP").when(index_id == 1, "CLUSTERED").otherwise("NONCLUSTERED")
    return df.groupBy(*keys).agg(
        F.sum(F.when(base, rows).otherwise(0)).alias("row_count"), (total * 8).alias("total_kb"),
        (data * 8).alias("data_kb"), ((total - data) * 8).alias("index_kb"), F.max(kind).alias("structure"))


def free_space(data: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Free space per database from data (size, free) and log (size, used) rows, with its band."""
    d = data.groupBy(*keys).agg(F.sum("size").alias("data_size"), F.sum("free").alias("data_free"))
    g = log.groupBy(*keys).agg(F.sum("size").alias("log_size"), F.sum("used").alias("log_used"))
    both = d.join(g, list(keys))
    total = F.col("data_size") + F.col("log_size")
    free = F.col("data_free") + F.col("log_size") - F.col("log_used")
    out = both.withColumns({"data_used": F.col("data_size") - F.col("data_free"),
                            "log_free": F.col("log_size") - F.col("log_used"),
                            "total_size": total, "total_free": free, "free_pct": percent(free, total)})
    p = F.col("free_pct")
    return out.withColumn("space_flag", band([(p < 0, "ERROR"), (p < 10, "LOW_FREE_SPACE"), (p < 20, "WATCH")], "OK"))


class CacheMix(NamedTuple):
    totals: DataFrame
    by_type: DataFrame


def cache_mix(df: DataFrame, kind: str, uses: Column, size: Column, adhoc: str = "Adhoc",
              by: Sequence[str] = ()) -> CacheMix:
    """Cache totals with the single-use share, and totals per entry type."""
    one_off = (uses == 1) & (F.col(kind) == adhoc)
    totals = df.groupBy(*by).agg(
        row_count().alias("entries"), count_if(one_off).alias("single_use"), count_if(uses > 1).alias("multi_use"),
        count_if(F.col(kind) == adhoc).alias("adhoc"), F.sum(size).alias("total_size"),
        F.sum(F.when(one_off, size).otherwise(0)).alias("single_use_size"))
    totals = totals.withColumn("single_use_pct", percent(F.col("single_use"), F.col("entries")))
    by_type = df.groupBy(*by, kind).agg(row_count().alias("entries"), F.sum(uses).alias("uses"),
                                        F.sum(size).alias("total_size"),
                                        ratio(F.sum(size), row_count()).alias("mean_size"))
    return CacheMix(totals, by_type)


def segment_health(df: DataFrame, keys: Sequence[str], size: Column, active: Column, many: int = 1000,
                   small=0.5, small_many: int = 100) -> DataFrame:
    """Log segments per database: counts, sizes, too-many and many-small flags."""
    s = exact(size, 4)
    out = df.groupBy(*keys).agg(
        row_count().alias("segments"), count_if(active).alias("active"), count_if(~active).alias("inactive"),
        F.min(s).alias("min_size"), F.max(s).alias("max_size"), F.sum(s).alias("total_size"))
    n = F.col("segments")
    return out.withColumns({
        "mean_size": ratio(F.col("total_size"), n, 4),
        "segment_flag": band([(n > many, "EXCESSIVE_VLF"),
                              ((F.col("min_size") < small) & (n > small_many), "MANY_SMALL_VLF")], "")})


def count_by(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] | None = None,
             maxima: Mapping[str, Column] | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(row_count().alias("rows"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()],
                                 *[F.max(c).alias(n) for n, c in (maxima or {}).items()])


def uniformity(df: DataFrame, keys: Sequence[str], size: str, growth: str, hot_rows: int | None = None) -> DataFrame:
    """Are all members of a group set up alike, and is this one less than half the mean?"""
    s = exact(F.col(size))
    rows = attach_group(df, keys, {"_n": row_count(), "_lo": F.min(s), "_hi": F.max(s), "_sum": F.sum(s),
                                   "_glo": F.min(growth), "_ghi": F.max(growth)}, hot_rows)
    yes_no = lambda c: F.when(c, "Y").otherwise("N")
    return rows.withColumns({
        "equal_sizes": yes_no(F.col("_lo") == F.col("_hi")),
        "equal_growth": yes_no(F.col("_glo") == F.col("_ghi")),
        "undersized": F.when(F.col("_n") <= 1, "N/A").otherwise(yes_no(s * 2 * F.col("_n") < F.col("_sum"))),
    }).drop("_n", "_lo", "_hi", "_sum", "_glo", "_ghi")


def window_counts(df: DataFrame, metrics: Mapping[str, tuple[Column, bool]], by: Sequence[str] = ()) -> DataFrame:
    """Labelled counts, all in one pass: label -> (condition, whether a hit is an issue)."""
    counts = df.groupBy(*by).agg(*[F.coalesce(count_if(c), F.lit(0)).alias(f"_{i}")
                                   for i, (c, _) in enumerate(metrics.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_{i}").alias("items"), F.lit(issue).alias("issue"))
                     for i, (n, (_, issue)) in enumerate(metrics.items())])
    return (counts.select(*by, F.explode(rows).alias("m"))
            .select(*by, "m.metric", "m.items", flag(F.col("m.issue") & (F.col("m.items") > 0)).alias("flag_issue")))


def utilisation(df: DataFrame, active: Column, capacity: DataFrame, by: Sequence[str] = (), limit: int = 90) -> DataFrame:
    """Active workers against a capacity: one number for all, or a row per group."""
    used = df.groupBy(*by).agg(row_count().alias("units"), F.sum(active).alias("active"))
    out = used.join(capacity, list(by)) if by else attach_scalar(used, capacity)
    return out.withColumns({"used_pct": percent(F.col("active"), F.col("capacity"), 1),
                            "flag_exhaustion": flag(F.col("active") * 100 > F.col("capacity") * limit)})
