"""From raw documents to a training mix, one stage after the other.

`STAGES` are applied in order; each is written as Parquet and read again as the next one's
documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import decontamination, mixing, near_duplicates, personal_data, quality
from fleetgauge.session import write_once


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the thresholds of their language and source reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least 5 % of their words inside benchmark passages go."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; n_chars follows."""
    return personal_data.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its number of copies (0 to 2) in a mix of the target weights: size, source_size,
    target, copies, taken. A column of the documents that has one of these names is kept with `_in` behind it."""
    mixed = mixing.mixed(docs, carry=True)
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = []
    for c in docs.columns:
        name = c
        while name in added or name != c and name in docs.columns:
            name += "_in"
        kept.append(F.col("_row").getField(c).alias(name))
    return mixed.select(*kept, *added)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("benchmark decontamination", drop_contaminated), ("personal data", redact), ("source mix", mix)]

#: Near duplicates, learned spans and the mix are iterative; SQL states none of them in full.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; every result but the last is written once and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
