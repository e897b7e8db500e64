"""One findings table for all checks, severities, and the run summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.labels import flag, label_of
from fleetgauge.functions.numbers import row_count
from fleetgauge.operators.aggregates import count_if


def flag_columns(df: DataFrame) -> list[str]:
    """Columns named flag_*, *_flag, *Flag or *_flags."""
    return [c for c in df.columns if c.lower().startswith("flag_") or c.lower().endswith(("flag", "_flags"))]


def findings(df: DataFrame, check: str, entity: Sequence[str], flags: Sequence[str] | None = None) -> DataFrame:
    """One row per flag that is set: a number other than 0, or a text other than '' and OK.

    Only the flags that are set are unfolded, so a healthy row costs nothing downstream.
    """
    names = list(flags or flag_columns(df))
    def value(c):
        if isinstance(df.schema[c].dataType, T.StringType):
            return F.when(~F.col(c).isin("", "OK", "N/A", "N"), F.col(c))
        return F.when(F.col(c) != 0, F.col(c).cast("string"))
    hits = F.array_compact(F.array(*[F.when(value(c).isNotNull(), F.struct(F.lit(c).alias("flag"), value(c).alias("value"))) for c in names]))
    # a missing part is named, so that it stays apart from a shorter entity
    ident = F.concat_ws("/", *[F.coalesce(F.col(e).cast("string"), F.lit("<null>")) for e in entity])
    return (df.select(F.lit(check).alias("check_id"), ident.alias("entity"), F.explode(hits).alias("h"))
            .select("check_id", "entity", "h.flag", "h.value"))


# Severity levels.
SEVERITY_LEVELS = ["Critical", "High", "Medium", "Low", "Informational"]


def score(found: DataFrame, severities: Mapping[str, str], chapters: Mapping[str, str] | None = None,
          by: Sequence[str] = (), other: str = "Informational") -> DataFrame:
    """Findings per chapter and severity; a flag without a rule is informational.

    Counted per check and flag first, so the labels are added to a small table.
    """
    counted = found.groupBy(*by, "check_id", "flag").agg(row_count().alias("n"))
    chapter = label_of(F.col("check_id"), chapters) if chapters else F.substring_index("check_id", "_", 1)
    return (counted.withColumns({"severity": label_of(F.col("flag"), severities, other), "chapter": chapter})
            .groupBy(*by, "chapter", "severity").agg(F.sum("n").alias("findings"), F.countDistinct("check_id", "flag").alias("kinds")))


def run_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sections run, ok and failed per chapter. A time-out stays a time-out, any failed
    section makes a chapter PARTIAL, a chapter whose sections were all skipped is SKIP."""
    s = F.col("status")
    section = F.coalesce("section", F.lit("")) != ""
    out = log.groupBy(*by, "chapter").agg(
        count_if(section & s.isin("OK", "WARN", "ERROR")).alias("sections_run"),
        count_if(section & s.isin("OK", "WARN")).alias("sections_ok"),
        count_if(section & (s == "ERROR")).alias("sections_failed"), count_if(section & (s == "SKIP")).alias("sections_skipped"),
        F.coalesce(F.sum("rows_exported"), F.lit(0)).alias("rows_exported"),
        F.max(flag(s == "TIMEOUT")).alias("_t"), F.max(flag(~section & (s == "ERROR"))).alias("_e"))
    status = (F.when(F.col("_t") == 1, "TIMEOUT").when(F.col("_e") == 1, "ERROR").when(F.col("sections_failed") > 0, "PARTIAL")
              .when((F.col("sections_run") == 0) & (F.col("sections_skipped") > 0), "SKIP").otherwise("OK"))
    return out.withColumn("chapter_status", status).drop("_t", "_e")
