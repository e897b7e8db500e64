"""Section files as they are exported: other columns per file, quotes, line breaks, marks."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.session import fit_shuffles, scratch_dir, write_once
from fleetgauge.sources import sections
from tests.conftest import rows


@pytest.fixture()
def exports(tmp_path):
    (tmp_path / "a.csv").write_text('\ufeff"Name","Text","CollectedAt","SqlInstance"\n"x","line 1\nline ""2"", end","2024-01-02T03:04:05Z","s1"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('"Size","Name","CollectedAt","SqlInstance"\n"7","y","2024-01-02T03:04:05Z","s2"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text('"CollectedAt","SqlInstance","Note"\n"2024-01-02T03:04:05Z","s3","No data returned"\n', encoding="utf-8")
    return tmp_path


SHAPE = "Name STRING, Text STRING, Size BIGINT"


def test_files_with_other_columns(spark, exports):
    got = rows(sections.read_section(spark, f"{exports}/*.csv", SHAPE), "Name", "Text", "Size", "sql_instance")
    assert got == [("x", 'line 1\nline "2", end', None, "s1"), ("y", None, 7, "s2")]


def test_known_layouts_give_the_same(spark, exports):
    meta = ["CollectedAt", "SqlInstance"]
    got = sections.read_section(spark, f"{exports}/*.csv", SHAPE, layouts={
        f"{exports}/a.csv": ["Name", "Text", *meta], f"{exports}/b.csv": ["Size", "Name", *meta], f"{exports}/c.csv": [*meta, "Note"]})
    assert rows(got) == rows(sections.read_section(spark, f"{exports}/*.csv", SHAPE))


def test_only_empty_sections(spark, exports):
    assert sections.read_section(spark, f"{exports}/c.csv", SHAPE).count() == 0


def test_parquet_sections(spark, tmp_path):
    spark.createDataFrame([("x", 1, None, "s1"), (None, None, "No data returned", "s2")], "Name string, Size bigint, Note string, SqlInstance string").write.parquet(f"{tmp_path}/p")
    assert rows(sections.read_section(spark, f"{tmp_path}/p", SHAPE, "parquet"), "Name", "Text", "Size") == [("x", None, 1)]


def test_writing_again_replaces_only_its_partitions(spark, tmp_path):
    day = lambda s, d, n: spark.range(n).select(F.col("id"), F.lit(s).alias("sql_instance"), F.lit(f"{d} 00:00:00").cast("timestamp").alias("collected_at"))
    sections.write_section(day("s1", "2024-01-01", 5).union(day("s2", "2024-01-01", 3)), str(tmp_path), "x")
    path = sections.write_section(day("s1", "2024-01-01", 2), str(tmp_path), "x")
    got = spark.read.parquet(path)
    assert rows(got.groupBy("sql_instance").count()) == [("s1", 2), ("s2", 3)]
    assert {"sql_instance", "run_date"} <= set(got.columns)


def test_scratch_lies_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "t")
    assert path.startswith(root or spark.conf.get("spark.checkpoint.dir"))
    assert rows(write_once(spark.range(3).toDF("n"), "t")) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("split", [16, 50, 333, 1 << 20])
def test_one_file_in_several_splits(spark, tmp_path, split):
    """Records with line breaks, doubled quotes and commas, longer than a split or not."""
    texts = ["plain", "two\nlines", 'a "quoted" word', "many\n\n\nbreaks, and commas,\n" + "long " * 30 + "\nend", '"', "", "x\n"] * 4
    (tmp_path / "a.csv").write_text("\ufeffName,Text,CollectedAt,SqlInstance\n" + "".join('n%d,"%s",2024-01-01 00:00:00,s1\n' % (i, t.replace('"', '""')) for i, t in enumerate(texts)))
    (tmp_path / "b.csv").write_text('"SqlInstance","CollectedAt","Size","Name"\ns2,2024-01-01 00:00:00,5,"m"\n')
    (tmp_path / "c.csv").write_text("Name,Size\nq,1\nr,2\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(split if "max" in k else 1))
        got = sections.read_section(spark, f"{tmp_path}/*.csv", "Name STRING, Text STRING, Size INT")
        want = [(f"n{i}", t or None, None, "s1") for i, t in enumerate(texts)] + [("m", None, 5, "s2")]
        assert rows(got, "Name", "Text", "Size", "sql_instance") == sorted(want, key=repr)
        assert [(r.header, r.records) for r in sections.quarantined(spark, f"{tmp_path}/*.csv").collect()] == [("Name,Size", 2)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def shuffles(spark):
    """The setting, put back whatever the test does."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda: spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_size(spark, shuffles):
    assert fit_shuffles(spark, 10 << 40) == 40_960 and shuffles() == "40960"
    assert fit_shuffles(spark, 100 << 40) == 409_600 and fit_shuffles(spark, 1 << 60) == 1_000_000
    assert fit_shuffles(spark, 100 << 40, most=100_000) == 100_000 and shuffles() == "100000"


def test_no_setting_is_left_behind(spark):
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


LOG = [f"[2024-01-02T03:04:{i % 60:02d}Z] [{'OK' if i % 3 else 'ERROR'}] [ch_{i % 7}] [s {chr(0x10A0 + i % 40)}\u0a05\u0100 \U0001f600] Exported {i} rows to f.csv" for i in range(500)]


@pytest.mark.parametrize("encoding, newline, mark", [("utf-16-le", "\r\n", True), ("utf-16-le", "\r\n", False), ("utf-16-be", "\r\n", True), ("utf-8", "\n", True), ("utf-8", "\r\n", False)])
@pytest.mark.parametrize("split", [100, 4096, 1 << 20])
def test_run_log_in_its_own_encoding(spark, tmp_path, encoding, newline, mark, split):
    name = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-8": "UTF-8"}[encoding]
    (tmp_path / "run.log").write_bytes(("\ufeff" * mark + newline.join(LOG) + newline).encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(split, 2000)))
        lines = sections.read_run_log(spark, str(tmp_path), name, newline)
        assert rows(lines) == sorted(((x,) for x in LOG), key=repr)
        twin = spark.createDataFrame([(x,) for x in LOG], "value string")
        assert rows(sections.parse_run_log(lines)) == rows(sections.parse_run_log(twin))
        assert split > 2000 or lines.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_log_cut_short_and_empty(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("\ufeffone\r\ntwo".encode("utf-16-le")[:-1])
    (tmp_path / "b.log").write_bytes(b"")
    assert rows(sections.read_run_log(spark, str(tmp_path))) == [("one",), ("tw",)]


def test_run_log_as_a_stream_equals_the_batch(spark, tmp_path):
    path = sections.write_run_log(spark.createDataFrame([(x,) for x in LOG], "value string").repartition(4), f"{tmp_path}/logs")
    query = (sections.parse_run_log(sections.read_run_log(spark, path, stream=True)).writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(sections.parse_run_log(sections.read_run_log(spark, path)))
    assert len(rows(sections.read_run_log(spark, path))) == len(LOG)
