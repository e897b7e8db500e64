"""Sorts, limits and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import label_of
from fleetgauge.functions.numbers import ratio
from fleetgauge.operators.skew import top_rows


def top_k(df: DataFrame, order: Sequence[Column], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 50) -> DataFrame:
    """Top rows per key. Ranking is per measured interval, not per query."""
    return top_rows(df, keys, order, n)


def severity_sort(df: DataFrame, label: str, ranks: dict[str, int], then: Sequence[Column], other: int = 50) -> DataFrame:
    """Rows by the rank of their label, then by the given keys; the rank stays as a column."""
    rank = F.coalesce(label_of(F.col(label), ranks, unknown=None), F.lit(other))
    return df.withColumn("severity_rank", rank).orderBy("severity_rank", *then)


# Order of log-reuse reasons.
LOG_REUSE_RANK = {"LOG_BACKUP": 1, "ACTIVE_TRANSACTION": 2, "AVAILABILITY_REPLICA": 3, "REPLICATION": 4,
                  "OLDEST_PAGE": 5, "DATABASE_SNAPSHOT_CREATION": 6, "NOTHING": 99}


def net_top(df: DataFrame, keys: Sequence[str], user: tuple[str, str], internal: tuple[str, str], n: int = 20,
            tie: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Largest net consumers: allocated minus released pages, positive only, pages as MB.

    `n` rows in all, or with `by` (say, the server) for each group.
    """
    net = lambda pair: F.col(pair[0]) - F.col(pair[1])
    rows = df.withColumns({"user_net": net(user), "internal_net": net(internal),
                           "total_net": net(user) + net(internal)})
    rows = rows.filter(F.col("total_net") > 0).withColumn("total_net_mb", ratio(F.col("total_net"), F.lit(128)))
    if by:
        return top_rows(rows, by, [F.desc("total_net"), *[F.col(c) for c in (*keys, *tie) if c not in by]], n)
    return rows.orderBy(F.desc("total_net"), *keys, *tie).limit(n)
