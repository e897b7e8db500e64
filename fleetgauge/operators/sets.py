"""Set jobs: branches, references, repeated rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_branches(branches: Mapping[str, DataFrame], label: str = "branch") -> DataFrame:
    """UNION ALL of labelled branches; a column missing in a branch is NULL there."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in branches.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_refs(refs: Sequence[tuple[DataFrame, str]], out: str = "ref") -> DataFrame:
    """Distinct non-NULL references; each source is made distinct before the union."""
    parts = [df.select(F.col(c).alias(out)).filter(F.col(out).isNotNull()).distinct() for df, c in refs]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def dedup_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows found by several searches appear once."""
    return df.select(*columns).distinct() if columns else df.distinct()
