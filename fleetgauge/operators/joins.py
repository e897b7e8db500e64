"""Join jobs: attach, coverage, gaps, orphans, pairs, reconciliation.

Data tables are never forced into a broadcast: Spark broadcasts a side only after comparing
its size with `spark.sql.autoBroadcastJoinThreshold`, again at run time with real sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import flag
from fleetgauge.functions.numbers import ratio, row_count
from fleetgauge.operators.skew import salted_join


def attach(fact: DataFrame, dims: Sequence[tuple[DataFrame, Mapping[str, str], str]]) -> DataFrame:
    """Equi-join a fact to catalogues: (dimension, {fact column: dimension column}, how)."""
    out = fact
    for dim, on, how in dims:
        cond = reduce(lambda a, b: a & b, [out[l] == dim[r] for l, r in on.items()])
        out = out.join(dim, cond, how)
    return out


def coverage(entities: DataFrame, facts: DataFrame, keys: Sequence[str],
             aggs: Mapping[str, Column]) -> DataFrame:
    """Every entity with what its facts say, and a flag when there are none."""
    per_key = facts.groupBy(*keys).agg(row_count().alias("matches"), *[c.alias(n) for n, c in aggs.items()])
    return (entities.join(per_key, list(keys), "left")
            .withColumn("flag_missing", flag(F.col("matches").isNull()))
            .withColumn("matches", F.coalesce("matches", F.lit(0))))


def coverage_gap(actual: DataFrame, expected: Sequence, key: str, active: Column,
                 label: str = "COVERAGE GAP", by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Actual rows, then one row for each expected value without an active actual row.

    With `by` (say, the server) every group is looked at by itself. `groups` names those that may
    have no actual row at all and so lack everything; the groups of `actual` are always in.
    """
    spark = actual.sparkSession
    kind = actual.schema[key].dataType
    every = actual.select(*by).union(groups.select(*by)) if groups is not None else actual.select(*by)
    every = every.distinct() if by else spark.range(1)
    wanted = (every.select(*by, F.explode(F.array(*[F.lit(v) for v in expected])).alias(key))
              .withColumn(key, F.col(key).cast(kind)))
    present = actual.filter(active & F.col(key).isin(*expected)).select(*by, key).distinct()
    gaps = (wanted.join(present, [*by, key], "left_anti")
            .withColumn("row_kind", F.concat(F.lit(label + ": "), F.col(key).cast("string"))))
    return (actual.withColumn("row_kind", F.lit("ACTUAL"))
            .unionByName(gaps, allowMissingColumns=True))


def has_match(df: DataFrame, other: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Rows with at least one matching row in `other`."""
    return salted_join(df, other.select(*keys).distinct(), keys, "left_semi", hot_rows)


def unsupported_keys(refs: DataFrame, support: DataFrame, keys: Sequence[str],
                     hot_rows: int | None = None) -> DataFrame:
    """References whose leading key leads nothing in `support`."""
    return salted_join(refs, support.select(*keys).distinct(), keys, "left_anti", hot_rows)


def orphans(df: DataFrame, principals: DataFrame, keys: Sequence[str], null_is_orphan: bool = False,
            hot_rows: int | None = None) -> DataFrame:
    """Rows whose id names no principal. Rows without an id count only if asked."""
    known = df
    if not null_is_orphan:
        for k in keys:
            known = known.filter(F.col(k).isNotNull())
    return salted_join(known, principals.select(*keys).distinct(), keys, "left_anti", hot_rows)


def pairs(df: DataFrame, group: Sequence[str], key: str, like: Sequence[str]) -> DataFrame:
    """Equal rows inside a group, as a star around the first of them.

    Members are `b.key > a.key` partners of `first_key`; `pair_count` says how many pairs
    the set holds. Listing every pair of a large set would grow with its square and say
    no more.
    """
    sets = df.groupBy(*group, *like).agg(F.min(key).alias("first_key"), row_count().alias("members"))
    sets = sets.filter(F.col("members") > 1)
    joined = salted_join(df, sets, [*group, *like], "inner").filter(F.col(key) > F.col("first_key"))
    m = F.col("members")
    return joined.select(*group, "first_key", F.col(key).alias("other_key"), *like, "members",
                         F.floor(m * (m - 1) / 2).cast("bigint").alias("pair_count"))


def attach_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """One-row aggregate on every row, as scalar subqueries: no join and no shuffle of `df`."""
    return df.withColumns({c: scalar.select(c).scalar() for c in scalar.columns})


def counts_per(df: DataFrame, facts: DataFrame, keys: Sequence[str],
               conditions: Mapping[str, Column | None], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts (0 when none) and sums (NULL when none) of each row's facts."""
    aggs = [F.sum(F.when(c, 1).otherwise(0) if c is not None else F.lit(1)).alias(n)
            for n, c in conditions.items()]
    aggs += [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    per_key = facts.groupBy(*keys).agg(*aggs)
    return (df.join(per_key, list(keys), "left")
            .withColumns({n: F.coalesce(n, F.lit(0)) for n in conditions}))


class Blocking(NamedTuple):
    pairs: DataFrame
    summary: DataFrame


def blocking(sessions: DataFrame, key: str, blocker: str, wait_ms: str, detail: Sequence[str] = (),
             by: Sequence[str] = ()) -> Blocking:
    """Blocked sessions beside their direct blocker, and totals."""
    blocked = sessions.filter(F.col(blocker) > 0)
    holders = sessions.select(*by, F.col(key).alias(blocker), *[F.col(c).alias(f"blocker_{c}") for c in detail])
    sec = (F.col(wait_ms) / 1000).cast("decimal(18,3)")
    rows = (salted_join(blocked, holders, [*by, blocker], "left")
            .select(*by, key, blocker, *detail, *[f"blocker_{c}" for c in detail], sec.alias("wait_sec")))
    totals = (blocked.groupBy(*by, blocker).agg(row_count().alias("n"), F.max(wait_ms).alias("mx"), F.sum(wait_ms).alias("total"))
              .groupBy(*by).agg(row_count().alias("direct_blockers"), F.sum("n").alias("blocked_sessions"),
                                (F.max("mx") / 1000).cast("decimal(18,3)").alias("max_wait_sec"),
                                ratio(F.sum("total"), F.sum("n") * 1000, 3).alias("avg_wait_sec")))
    return Blocking(rows, totals)


def shares_location(df: DataFrame, other: DataFrame, keys: Sequence[str], location: Sequence[str],
                    out: str = "shares_location") -> DataFrame:
    """'Y' when the same entity has a row of `other` at the same location."""
    on = [*keys, *location]
    spots = other.select(*on).distinct().withColumn("_hit", F.lit("Y"))
    return salted_join(df, spots, on, "left").withColumn(out, F.coalesce("_hit", F.lit("N"))).drop("_hit")


def misaligned(df: DataFrame, keys: Sequence[str], kind: Column, base: Column, space: str) -> DataFrame:
    """Secondary objects placed elsewhere than a base object of the same owner.

    An owner whose base lies in several places yields one row per differing place.
    """
    places = df.filter(base).select(*keys, F.col(space).alias(f"base_{space}")).distinct()
    return (salted_join(df.filter(kind), places, keys, "inner")
            .filter(F.col(space) != F.col(f"base_{space}")))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Two sources side by side: where each is missing and by how much they differ."""
    a = left.groupBy(*keys).agg(*[F.sum(m).alias(f"a_{m}") for m in measures], F.lit(1).alias("_a"))
    b = right.groupBy(*keys).agg(*[F.sum(m).alias(f"b_{m}") for m in measures], F.lit(1).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    state = (F.when(F.col("_b").isNull(), "ONLY_FIRST").when(F.col("_a").isNull(), "ONLY_SECOND")
             .otherwise("BOTH"))
    return both.select(*keys, state.alias("presence"), *[f"a_{m}" for m in measures],
                       *[f"b_{m}" for m in measures],
                       *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(f"diff_{m}") for m in measures])
