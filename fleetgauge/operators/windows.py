"""Ordered histories: gaps, chains, latest rows, regressions, counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.labels import flag
from fleetgauge.functions.numbers import exact, ratio, row_count, whole_ratio
from fleetgauge.functions.times import boundary_diff, instant
from fleetgauge.operators.joins import attach_scalar
from fleetgauge.operators.skew import Scan, attach_group, ordered_scan, salted_join, top_candidates, top_rows


def gaps(df: DataFrame, keys: Sequence[str], ts: str, start: str | None = None, tie: Sequence[str] = (),
         unit: str = "minute", hot_rows: int | None = None) -> DataFrame:
    """Gap since the previous event of the key, in boundaries crossed.

    Without `start` from end to end; with `start` from the previous end to this start.
    The first event of a key has a NULL gap.
    """
    rows = ordered_scan(df, keys, [ts, *tie], [Scan(previous={"previous": ts})], hot_rows)
    return rows.withColumn("gap", boundary_diff(unit, F.col("previous"), F.col(start or ts)))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, limit: str, hot_rows: int | None = None) -> DataFrame:
    """Runs of events of a key in which each follows the one before by no more than `limit`: first_event,
    last_event and events. Rows without a time belong to none.

    A hot key is cut into ranges. The event before a range's first one says whether it goes on a run, so
    all runs inside a range are whole; only the first and last of each range, two rows at most, are put
    together across ranges.
    """
    keys = list(keys)
    placed = ordered_scan(df.filter(F.col(ts).isNotNull()).select(*keys, ts), keys, [ts], [Scan(previous={"_before": ts})], hot_rows, "_range")
    opens = F.coalesce(F.col(ts) > F.col("_before") + F.expr(f"INTERVAL {limit}"), F.lit(True))
    order = Window.partitionBy(*keys, "_range").orderBy(ts, "_before").rowsBetween(Window.unboundedPreceding, 0)
    # 0 for the run that a range takes over from the one before
    numbered = placed.withColumn("_run", F.sum(flag(opens)).over(order))
    part = numbered.groupBy(*keys, "_range", "_run").agg(F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), row_count().alias("events"))
    last = F.max("_run").over(Window.partitionBy(*keys, "_range"))
    part = part.withColumn("_edge", (F.col("_range") > 0) & ((F.col("_run") == 0) | (F.col("_run") == last)))
    across = Window.partitionBy(*keys).orderBy("_range", "_run").rowsBetween(Window.unboundedPreceding, 0)
    edges = part.filter("_edge").withColumn("_joined", F.sum(flag(F.col("_run") > 0)).over(across))
    merged = edges.groupBy(*keys, "_joined").agg(F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), F.sum("events").alias("events"))
    columns = [*keys, "first_event", "last_event", "events"]
    return part.filter("not _edge").select(*columns).unionByName(merged.select(*columns))


def gap_stats(gapped: DataFrame, keys: Sequence[str], ts: str, count_first: bool = False,
              limit: int = 60) -> DataFrame:
    """Count, mean, maximum and last time. The first event of a key is left out of the
    count unless `count_first`; a key with nothing else is then absent."""
    rows = gapped if count_first else gapped.filter(F.col("gap").isNotNull())
    return (rows.groupBy(*keys)
            .agg(row_count().alias("events"), F.sum("gap").alias("_sum"), F.count("gap").alias("_n"),
                 F.max("gap").alias("max_gap"), F.max(ts).alias("last_event"),
                 F.sum(flag(F.col("gap") > limit)).alias("gaps_over_limit"))
            .withColumn("mean_gap", ratio(F.col("_sum"), F.col("_n"), 1)))


def gap_list(gapped: DataFrame, keys: Sequence[str], ts: str, limit: int = 60) -> DataFrame:
    """Gaps above a limit with their length in hours."""
    return gapped.filter(F.col("gap") > limit).select(
        *keys, F.col("previous").alias("previous_event"), F.col(ts).alias("this_event"), "gap",
        whole_ratio(F.col("gap"), F.lit(60), 1).alias("gap_hours"))


def chain_audit(df: DataFrame, entity: Sequence[str], kind: str, start: str, first: str, last: str, base: str,
                attr: str, copy_only: Column, tie: Sequence[str] = (), codes: Sequence[str] = ("D", "I", "L"),
                hot_rows: int | None = None) -> DataFrame:
    """One row per anomaly of a backup chain.

    A log must start where the previous one of its type ended; the attribute must not change
    from one backup to the next of any type; a differential must name the base in force,
    which is the largest end of any earlier full that is not copy-only; copy-only fulls are
    reported as such.
    """
    full, diff, log = codes
    k = F.col(kind)
    marked = df.withColumn("_base", F.when((k == full) & ~copy_only, F.col(last)))
    seen = ordered_scan(marked, entity, [start, *tie], [
        Scan(previous={"_prev_last": last}, by=[kind]),
        Scan(previous={"_prev_attr": attr}, prior_max={"_last_base": "_base"}),
    ], hot_rows)
    text = lambda c: F.col(c).cast("string")
    notes = F.array(
        F.when((k == log) & F.col("_prev_last").isNotNull() & (F.col(first) != F.col("_prev_last")),
               F.struct(F.lit("SEQUENCE_GAP").alias("anomaly"), F.concat(
                   F.lit("starts at "), text(first), F.lit(", previous log ended at "), text("_prev_last")).alias("note"))),
        F.when(F.col("_prev_attr").isNotNull() & (F.col(attr) != F.col("_prev_attr")),
               F.struct(F.lit("ATTRIBUTE_CHANGE").alias("anomaly"), F.concat(
                   F.lit("was "), text("_prev_attr"), F.lit(", now "), text(attr)).alias("note"))),
        F.when((k == diff) & F.col("_last_base").isNotNull() & (F.col(base) != F.col("_last_base")),
               F.struct(F.lit("BASE_MISMATCH").alias("anomaly"), F.concat(
                   F.lit("names base "), text(base), F.lit(", last full ended at "), text("_last_base")).alias("note"))),
        F.when((k == full) & copy_only,
               F.struct(F.lit("COPY_ONLY_FULL").alias("anomaly"), F.lit("does not reset the base").alias("note"))),
    )
    return (seen.select(*df.columns, F.explode(F.array_compact(notes)).alias("_n"))
            .select(*df.columns, "_n.anomaly", "_n.note"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order; end the order with something unique."""
    return top_rows(df, keys, order, 1).drop("rn")


def latest_ties(df: DataFrame, keys: Sequence[str], ts: str, hot_rows: int | None = None) -> DataFrame:
    """All rows at the latest time of their key; ties are kept. Rows of a key without any time tie.

    The latest time per key is an aggregate. Every map partition is cut to its latest rows before the shuffle;
    what is left is met by key and time, so however many tie, no task has to hold or sort them.
    """
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(ts).alias(ts), F.count(F.lit(1)).alias("_rows"))
    near = top_candidates(df, keys, [F.desc_nulls_last(ts)], hot_rows, top.select(*keys, "_rows"))
    return salted_join(near, top.drop("_rows"), [*keys, ts], "left_semi", hot_rows, True, top).select(*df.columns)


def last_n_stats(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ts: str, size: Column,
                 seconds: Column, n: int = 10) -> DataFrame:
    """Means over the last n rows per key, and mean size by mean time."""
    s, d = exact(size), seconds.cast("decimal(18,0)")
    out = top_rows(df, keys, order, n).groupBy(*keys).agg(
        row_count().alias("runs"), F.sum(s).alias("_s"), F.sum(d).alias("_d"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
    return out.select(*keys, "runs", ratio(F.col("_s"), F.col("runs")).alias("mean_size"),
                      ratio(F.col("_d"), F.col("runs"), 1).alias("mean_sec"),
                      F.when(F.col("_d") > 0, ratio(F.col("_s"), F.col("_d"))).alias("throughput"), "oldest", "newest")


def regressions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], metric: str, factor: int = 2,
                carry: Sequence[str] = ()) -> DataFrame:
    """Newest against second newest measurement, kept when more than `factor` times as large.
    The two may come from different plans."""
    two = top_rows(df, keys, order, 2)
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    out = two.groupBy(*keys).agg(pick(metric, 1).alias("recent"), pick(metric, 2).alias("earlier"),
                                 *[pick(c, 1).alias(c) for c in carry])
    return (out.filter((F.col("earlier") > 0) & (F.col("recent") > F.col("earlier") * factor))
            .withColumn("times_slower", ratio(exact(F.col("recent")), exact(F.col("earlier")), 4)))


def share(df: DataFrame, metric: str, by: Sequence[str] = (), out: str = "share_pct",
          hot_rows: int | None = None) -> DataFrame:
    """Percent of the total (or of the group total); NULL when the total is 0. The metric
    holds whole numbers (milliseconds, pages, cents)."""
    if by:
        rows = attach_group(df, by, {"_total": F.sum(metric)}, hot_rows)
    else:
        rows = attach_scalar(df, df.agg(F.sum(metric).alias("_total")))
    return rows.withColumn(out, whole_ratio(F.col(metric), F.col("_total"), 2, 100)).drop("_total")


def recurrence(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """How often the key of each row occurs, and whether more than once."""
    rows = attach_group(df, keys, {"occurrences": row_count()}, hot_rows)
    return rows.withColumn("flag_recurring", flag(F.col("occurrences") > 1))


def peer_deviation(df: DataFrame, keys: Sequence[str], metric: str, limit=25, factor: int | None = None,
                   hot_rows: int | None = None) -> DataFrame:
    """Value against the mean of its peers: off by more than `limit` percent, or more than
    `factor` times the mean. A group of one has no peers."""
    v = exact(F.col(metric))
    rows = attach_group(df, keys, {"peers": row_count(), "_sum": F.sum(v)}, hot_rows)
    n, total = F.col("peers"), F.col("_sum")
    if factor is not None:
        hit = (total > 0) & (v * n > total * factor)
    else:
        hit = (n > 1) & (F.abs(v * n - total) * 100 > F.abs(total) * limit)
    return rows.withColumns({"peer_mean": ratio(total, n), "ratio_to_mean": ratio(v * n, total, 4),
                             "flag_deviation": flag(hit)}).drop("_sum")


def status_at_last(df: DataFrame, keys: Sequence[str], ts: str, status: str) -> DataFrame:
    """Status of the latest run; among runs at the same time the largest status wins."""
    return (df.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(status).alias("s"))).alias("m"))
            .select(*keys, F.col("m.t").alias("last_run"), F.col("m.s").alias("last_status")))


def exposure(entities: DataFrame, stats: DataFrame, keys: Sequence[str], as_of, model: str,
             models: Sequence[str] = ("FULL",), limit: int = 60) -> DataFrame:
    """Entities beside their gap statistics: missed windows, exposed now, no event at all."""
    rows = entities.join(stats, list(keys), "left")
    minutes = boundary_diff("minute", F.col("last_event"), instant(as_of))
    watched = F.col(model).isin(*models)
    return rows.withColumns({
        "minutes_since_last": minutes,
        "flag_missed_window": flag(watched & (F.col("max_gap") > limit)),
        # the mean is compared unrounded: minutes > sum / n
        "flag_exposed": flag(watched & (F.col("last_event").isNull() | F.coalesce(
            minutes * F.col("_n") > F.col("_sum"), minutes > 0))),
        "flag_no_event": flag(watched & F.col("last_event").isNull()),
    }).drop("_sum", "_n")


def counter_delta(df: DataFrame, keys: Sequence[str], ts: str, counters: Mapping[str, str], epoch: str | None = None,
                  tie: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Growth of cumulative counters since each one's last known value. After a restart (a smaller
    value of any counter, or another start time) the counter's own value is the growth.

    A missing value has no growth, and what the counter grew by meanwhile is told at its next value.
    """
    known = {f"_p_{c}": c for c in counters.values()}
    scan = Scan(prior_known=known, previous={"_p_epoch": epoch} if epoch else {})
    rows = ordered_scan(df, keys, [ts, *tie], [scan], hot_rows)
    fell = F.lit(False)
    for c in counters.values():
        fell = fell | F.coalesce(F.col(c) < F.col(f"_p_{c}"), F.lit(False))
    started = F.coalesce(*[F.col(p) for p in known]).isNotNull()
    if epoch:
        fell = fell | (started & ~F.col(epoch).eqNullSafe(F.col("_p_epoch")))
    rows = rows.withColumn("flag_restart", flag(fell))
    restarted = F.col("flag_restart") == 1
    deltas = {out: F.when(F.col(f"_p_{c}").isNotNull() & F.col(c).isNotNull(), F.when(restarted, F.col(c)).otherwise(F.col(c) - F.col(f"_p_{c}")))
              for out, c in counters.items()}
    return rows.withColumns(deltas).drop(*known, "_p_epoch")
