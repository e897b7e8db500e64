"""Result files of check sections: reading, merging, writing, and the run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.labels import any_of
from fleetgauge.functions.times import read_instant
from fleetgauge.operators.skew import salted_join
from fleetgauge.session import write_once

EMPTY_NOTE = "No data returned"
META = "Note STRING, CollectedAt TIMESTAMP, SqlInstance STRING"


def read_section(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType,
                 fmt: str = "csv", layouts: Mapping[str, Sequence[str]] | None = None, **options) -> DataFrame:
    """One section's files of many servers and runs as one table.

    `schema` is the union of the columns any file may have. CSV columns are matched by header
    name, file by file, so files may differ in columns and order. Marker rows of empty
    sections are dropped; server and collection time become the last columns.

    A large CSV file is read in splits like any text (`csv_records`); files whose header lacks the server
    or the time are left out here and listed by `quarantined`. Where the layout of each glob is known,
    `layouts` (glob -> column names in file order) reads it file by file without looking for headers.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    meta = T.StructType.fromDDL(META)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "csv" and not layouts:
        raw = _parsed(csv_records(spark, paths), wanted, meta, options)
    elif fmt == "csv":
        groups = {tuple(names): [glob] for glob, names in layouts.items()}
        # exports quote by doubling, and texts hold line breaks
        options = {"escape": '"', "multiLine": True, **options}
        none = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in [*wanted, *meta]])
        frames = [_csv(spark, files, header, wanted, meta, options) for header, files in groups.items()]
        raw = reduce(lambda a, b: a.unionByName(b), frames, none)
    else:
        full = T.StructType([*wanted, *[f for f in meta if f.name not in wanted.names]])
        raw = spark.read.schema(full).options(**options).format(fmt).load(paths)
    rows = raw.filter(F.col("Note").isNull() | (F.col("Note") != EMPTY_NOTE))
    names = [c for c in wanted.names if c not in meta.names]
    return rows.select(*names, F.col("SqlInstance").alias("sql_instance"), F.col("CollectedAt").alias("collected_at"))


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of CSV files with the header of their file: path, header, record. Texts in quotes may hold line
    breaks, and a file may be cut into any number of splits.

    A line break ends a record if an even number of quotes stands before it in the file. Quotes are counted per
    split; their running sums, one row per split, tell whether a split begins inside a text. Only
    records of several lines are put together by a shuffle on their own.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    # lines stay in their order; numbered once, so that a task run again gives the same
    lines = write_once(lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))), "lines")
    here = Window.partitionBy("path", "split").orderBy("line")
    before = F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "split").agg(F.sum("quotes").alias("_q"))
    splits = splits.select(F.col("path").alias("_p"), F.col("split").alias("_s"), (F.coalesce(F.sum("_q").over(earlier), F.lit(0)) % 2).alias("_inside"))
    counted = lines.withColumn("_before", before).join(splits, (F.col("path") == F.col("_p")) & (F.col("split") == F.col("_s")))
    starts = (F.col("_before") + F.col("_inside")) % 2 == 0
    marked = write_once(counted.select("path", "split", "line", "value", starts.alias("starts"), (starts & (F.col("quotes") % 2 == 0)).alias("whole")), "marked-lines")
    # lines of longer records: numbered by the start before them, inside the split or in an earlier one
    parts = marked.filter("not whole")
    own = F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    last = parts.filter("starts").groupBy("path", "split").agg(F.max("line").alias("_line"))
    ends = parts.select("path", "split").distinct().join(last, ["path", "split"], "left")
    carried = ends.select(F.col("path").alias("_p"), F.col("split").alias("_s"), F.last("_line", ignorenulls=True).over(earlier).alias("_open"))
    owned = parts.withColumn("_own", own).join(carried, (F.col("path") == F.col("_p")) & (F.col("split") == F.col("_s")))
    # a record's lines are as many as its texts have line breaks
    joined = (owned.groupBy("path", F.coalesce("_own", "_open").alias("_first")).agg(F.min(F.struct("split", "line")).alias("_at"), F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("_l"))
              .select("path", F.col("_at.split").alias("split"), F.col("_at.line").alias("line"), F.array_join(F.col("_l.value"), "\n").alias("record")))
    records = marked.filter("whole").select("path", "split", "line", F.col("value").alias("record")).unionByName(joined)
    records = write_once(records.withColumn("record", F.regexp_replace("record", "^\ufeff", "")), "records")
    heads = records.groupBy("path").agg(F.min(F.struct("split", "line", "record")).alias("_h")).select("path", "_h.split", "_h.line", F.col("_h.record").alias("header"))
    headed = salted_join(records, heads.select("path", F.col("split").alias("_hs"), F.col("line").alias("_hl"), "header"), ["path"])
    return headed.filter(~((F.col("split") == F.col("_hs")) & (F.col("line") == F.col("_hl"))) & (F.col("record") != "")).select("path", "header", "record")


#: Different headers that one section's files may have.
MOST_LAYOUTS = 1_000


def _names(header: str) -> list[str]:
    return [n.strip().strip('"') for n in header.split(",")]


def _has_meta(header: Column) -> Column:
    named = lambda c: header.rlike(f'(^|,)"?{c}"?(,|$)')
    return named("CollectedAt") & named("SqlInstance")


def _parsed(records: DataFrame, wanted: T.StructType, meta: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """Records as typed columns by the names in their header. Headers, not paths, come to the driver."""
    known = {f.name: f for f in [*wanted, *meta]}
    records = write_once(records.filter(_has_meta(F.col("header"))), "section")
    headers = sorted(r.header for r in records.select("header").distinct().limit(MOST_LAYOUTS + 1).collect())
    if len(headers) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} layouts in one section")
    typed = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **{k: str(v) for k, v in options.items()}}
    row = F.lit(None).cast(T.StructType(list(known.values())))
    for header in headers:
        names = _names(header)
        shape = ", ".join(f"`{n}` {known[n].dataType.simpleString() if n in known else 'string'}" for n in names)
        got = F.from_csv("record", shape, typed)
        fields = [got.getField(n).alias(n) if n in names else F.lit(None).cast(f.dataType).alias(n) for n, f in known.items()]
        row = F.when(F.col("header") == header, F.struct(*fields)).otherwise(row)
    return records.select(row.alias("_r")).select("_r.*")


def quarantined(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files without the server or the time of collection in their header: path, header and number of records."""
    records = csv_records(spark, [paths] if isinstance(paths, str) else list(paths))
    return records.filter(~_has_meta(F.col("header"))).groupBy("path", "header").agg(F.count(F.lit(1)).alias("records"))


def _csv(spark, files, header, wanted, meta, options) -> DataFrame:
    known = {f.name: f for f in [*wanted, *meta]}
    shape = T.StructType([T.StructField(n, known[n].dataType if n in known else T.StringType()) for n in header])
    frame = spark.read.schema(shape).options(header=True, enforceSchema=True, **options).csv(files)
    return frame.select(*[F.col(n) if n in header else F.lit(None).cast(f.dataType).alias(n) for n, f in known.items()])


def with_empty_marker(df: DataFrame, note: str = EMPTY_NOTE) -> DataFrame:
    """The rows, or exactly one row with a note when there are none. The emptiness test is an
    uncorrelated subquery that stops at the first row."""
    marker = df.sparkSession.range(1).select(F.lit(note).alias("Note")).where(~df.limit(1).exists())
    return df.withColumn("Note", F.lit(None).cast("string")).unionByName(marker, allowMissingColumns=True)


def merge_sets(sets: Mapping[str, DataFrame], label: str = "ResultSetName") -> DataFrame:
    """Several result sets of one check as one table with the union of their columns."""
    frames = [df.withColumn(label, F.lit(name)) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_section(df: DataFrame, root: str, section: str, mode: str = "overwrite",
                  instance: str = "sql_instance", collected_at: str = "collected_at") -> str:
    """Write one section as Parquet below root/section, partitioned by server and run day.

    Only the partitions present in `df` are replaced, so a repeated run does not double rows.
    Rows are brought together by partition first, so that small servers give few files; a
    large one is split over several tasks by the adaptive rebalance.
    """
    path = f"{root.rstrip('/')}/{section}"
    day = F.to_date(collected_at)
    (df.withColumn("run_date", day).hint("rebalance", F.col(instance), F.col("run_date"))
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(instance, "run_date").parquet(path))
    return path


# Fixed value: shape of a run-log line.
LOG_LINE = r"^\[([^\]]*)\]\s+\[([^\]]*)\]\s+\[([^\]]*)\]\s+\[([^\]]*)\]\s?(.*)$"


#: Bytes of the log's line end in its encoding, as the text source compares them.
LOG_ENCODING, LOG_NEWLINE = "UTF-16LE", "\r\n"


def read_run_log(spark: SparkSession, path: str, encoding: str = LOG_ENCODING, newline: str = LOG_NEWLINE, stream: bool = False) -> DataFrame:
    """Lines of run logs in a two-byte (or any other) encoding: `value`, for `parse_run_log`.

    The text source cuts files at the bytes of `newline` in that encoding, so one large log is read by
    several tasks and a stream keeps which files it has read; the lines are decoded as columns. A byte
    order mark, and a carriage return left by `newline="\\n"`, are taken off. In UTF-16 the default's four
    bytes can stand nowhere but at a line end (a shifted match would need U+0A00, which is no character).
    As a stream, a file is read once, when it appears: move logs in when they are finished. Bytes that are
    no text in the encoding become the replacement character; the line stays.
    """
    reader = (spark.readStream if stream else spark.read).option("lineSep", newline.encode(encoding).decode("latin-1"))
    raw = F.col("value").cast("binary")
    size = len("x".encode(encoding))
    # decode() ends the job on half a character; a line cut short, as of a log still written, loses it
    whole = F.substring(raw, F.lit(1), F.length(raw) - F.length(raw) % size) if size > 1 else raw
    text = F.regexp_replace(F.decode(whole, encoding), "^\ufeff|\r$", "")
    return reader.text(path).select(text.alias("value")).filter("value <> ''")


def write_run_log(lines: DataFrame, path: str, column: str = "value", encoding: str = LOG_ENCODING, newline: str = LOG_NEWLINE) -> str:
    """Lines as log files in the encoding, without a mark; one file per partition."""
    coded = F.encode(F.col(column), encoding).cast("string")
    lines.select(coded.alias("value")).write.mode("overwrite").option("lineSep", newline.encode(encoding).decode("latin-1")).text(path)
    return path


def parse_run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Run-log lines to columns; exported rows are read from the message. Other lines are dropped."""
    part = lambda i: F.regexp_extract(F.col(column), LOG_LINE, i)
    rows = lines.filter(F.col(column).rlike(LOG_LINE)).select(
        read_instant(part(1)).alias("logged_at"),
        F.upper(F.trim(part(2))).alias("status"), part(3).alias("chapter"), part(4).alias("section"), part(5).alias("message"))
    count = F.regexp_extract("message", r"^Exported (\d+) rows", 1)
    return rows.withColumn("rows_exported", F.when(count != "", count.cast("bigint")))


class Split(NamedTuple):
    good: DataFrame
    failed: DataFrame


def split_failures(df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> Split:
    """Rows that record a failed collection (-1, or a text starting `ERROR: `) apart from the rest."""
    tests: list[Column] = [F.col(c) == -1 for c in numbers] + [F.col(c).startswith("ERROR: ") for c in texts]
    bad = F.coalesce(any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))
    return Split(df.filter(~bad), df.filter(bad))


def fan_in(frames: Mapping[str, DataFrame], label: str = "database") -> DataFrame:
    """Tables of many databases as one; where they already share a table, use its column."""
    return merge_sets(frames, label)
