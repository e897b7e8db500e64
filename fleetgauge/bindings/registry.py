"""Every operator bound to the supplied tables, beside an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-12-01 00:00:00"


class Tables:
    """The supplied tables by name: `t.orders`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}.parquet"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison across engines."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema])


def bind(name: str, sql: str | None = None):
    """Register a query; `sql` is what it must equal."""
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def half_up(num: str, den: str, scale: int = 2, times: int = 1) -> str:
    """SQL for num * times / den rounded half up; whole numbers, NULL at den = 0."""
    p = 10 ** scale
    n, d = f"({times}::HUGEINT * ({num}))", f"nullif({den}, 0)"
    return (f"CASE WHEN ({num}) >= 0 THEN CAST((2 * {p} * {n} + {d}) // (2 * {d}) AS DOUBLE) / {p} "
            f"ELSE -(CAST((2 * {p} * (-{n}) + {d}) // (2 * {d}) AS DOUBLE) / {p}) END")


def cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"
