"""Session settings the jobs expect, and the folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep splitting a skewed join even if that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash-aggregate lists of up to this many groups before falling back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # merge sessions before the shuffle, so a hot entity sends few rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "fleetgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. On a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fit_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 << 20, most: int = 1_000_000) -> int:
    """Set the number of shuffle partitions for an input of known size.

    Adaptive execution merges small partitions afterwards but never makes more of them, so
    start high: 100 TB asks for about 400,000. `most` is there to spare the driver beyond that.
    """
    n = min(max(-(-input_bytes // target_bytes), spark.sparkContext.defaultParallelism), most)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by `spark.checkpoint.dir`.

    Only in local mode (tests), where driver and executor are one process, a local folder is
    made if that setting is absent; anywhere else its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fleetgauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's own setting to remove the shuffle files of a query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write a derived table that several branches of a job read, and read it back.

    Cuts the lineage at a table in the shared folder, so that a lost executor does not mean
    deriving it again, and later scans read only the columns they need. `drop_shuffles` removes
    the shuffle files behind the table once it is written, not when the driver next collects
    garbage; the session's setting stays as it was.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    before = spark.conf.get(DROP_SHUFFLES, None)
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles and before is None:
            spark.conf.unset(DROP_SHUFFLES)
        elif drop_shuffles:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
