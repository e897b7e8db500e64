"""The pipeline: stages in order, columns carried, decisions in effect, each as brute force has it."""

import corpus_pipeline
from fleetgauge.llm import decontamination, personal_data, quality
from tests.llm import brute


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "source mix"]


def test_each_stage_on_what_the_one_before_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]

    good = stages[0](spark, docs, small)
    assert good.columns == columns
    failed = {r.doc_id for r in quality.quality(docs).filter("not kept").collect()}
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - failed

    single = stages[1](spark, good, small)
    assert single.columns == columns
    listed = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in brute.near_duplicates(listed, shingle=5) if r[3])

    clean = stages[2](spark, single, small)
    assert clean.columns == columns
    listed = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in brute.contamination(listed, items) if not r[5])

    safe = stages[3](spark, clean, small)
    assert safe.columns == columns and safe.count() == clean.count()
    assert all(not brute.base_spans(r.text) and r.n_chars == len(r.text) for r in safe.collect())

    mixed = stages[4](spark, safe, small)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert mixed.columns[:len(columns)] == columns and {r.doc_id: r.text for r in mixed.collect()} == texts

    whole = {r.doc_id: (r.text, r.copies) for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {r.doc_id: (r.text, r.copies) for r in mixed.collect()}


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
    assert decontamination.remove_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert personal_data.redacted(docs).columns == docs.columns


def test_stages_carry_clashing_columns(spark, small):
    listed = [r for r in brute.documents() if r[0] is not None]
    docs = spark.createDataFrame(listed, brute.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small)
        assert docs.columns == [c.split()[0] for c in brute.SCHEMA.split(", ")]
    assert 0 < docs.count() < len(listed)
