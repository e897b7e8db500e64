"""Prefix families by interval labels, against plain comparison of all lists."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import overlap, prefixes
from tests.conftest import rows

SIG = "obj int, idx int, key_columns array<string>, include_columns array<string>, flt string"


def indexes(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        keys = [rng.choice(["a", "b", "ab", "a:ASC", "\U0001f600"]) for _ in range(rng.randint(0, 5))]
        out.append((rng.choice([1, 1, 1, 2, None]), i, keys, rng.choice([[], [], ["x"]]), rng.choice([None, "", "p=1"])))
    return out


def plain_pairs(listed):
    out = []
    for a in listed:
        for b in listed:
            if a[0] == b[0] and a[1] < b[1] and a[2] and b[2]:
                if a[2] == b[2]:
                    if a[3] == b[3] and (a[4] or "") == (b[4] or ""):
                        out.append((a[1], b[1], "EXACT_DUPLICATE"))
                elif b[2][:len(a[2])] == a[2]:
                    out.append((a[1], b[1], "INDEX1_IS_PREFIX"))
                elif a[2][:len(b[2])] == b[2]:
                    out.append((a[1], b[1], "INDEX2_IS_PREFIX"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_come_back(spark, seed):
    listed = indexes(seed)
    families = overlap.duplicate_families(spark.createDataFrame(listed, SIG).repartition(5), ["obj"], "idx", "flt")
    families = spark.createDataFrame(families.collect(), families.schema)
    assert rows(overlap.family_pairs(families, ["obj"], "idx"), "index_1", "index_2", "duplicate_type") == plain_pairs(listed)
    # and from the numbers alone
    f = {r.idx: r for r in families.collect()}
    assert set(f) == {r[1] for r in listed if r[2]}
    found = []
    for a in f.values():
        for b in f.values():
            if a.idx < b.idx and a.first_equal == b.first_equal:
                found.append((a.idx, b.idx, "EXACT_DUPLICATE"))
            if a.entry < b.entry < a.exit:
                found.append((min(a.idx, b.idx), max(a.idx, b.idx), "INDEX1_IS_PREFIX" if a.idx < b.idx else "INDEX2_IS_PREFIX"))
    assert sorted(found, key=repr) == plain_pairs(listed)


def test_three_lists_where_the_star_misses_a_pair(spark):
    listed = [(1, 1, ["a"], ["x"], None), (1, 2, ["a"], ["y"], None), (1, 3, ["a", "b"], [], None)]
    families = overlap.duplicate_families(spark.createDataFrame(listed, SIG), ["obj"], "idx", "flt")
    assert rows(overlap.family_pairs(families, ["obj"], "idx"), "index_1", "index_2") == [(1, 3), (2, 3)]


def test_families_of_a_large_group(spark):
    """20,000 copies and 20,000 lists that go on from theirs: one row each."""
    lists = spark.range(40_000).select(F.lit(1).alias("obj"), F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.col("id").cast("string"))).alias("key_columns"),
                                       F.array().cast("array<string>").alias("include_columns"))
    found = overlap.duplicate_families(lists, ["obj"], "idx")
    assert found.count() == 40_000
    assert rows(found.groupBy("set_size", "longer_lists").count()) == [(1, 0, 20_000), (20_000, 20_000, 20_000)]


def test_texts_of_ten_thousand_lengths(spark):
    """Statistics of one table whose lists all differ in length, a few being the start of others."""
    listed = [(1, i, ["abc"[i % 3] + "x" * (i + 1)], None) for i in range(10_000)] + [(1, 10_000 + i, [c], None) for i, c in enumerate("abc")] + [(1, 10_010, ["axx"], "p")]
    sig = spark.createDataFrame(listed, "obj int, idx int, key_columns array<string>, flt string").filter("idx % 500 < 3 or idx >= 10000")
    found = rows(overlap.overlapping_stats(sig, ["obj"], "idx", "flt"), "stat_1", "stat_2")
    kept = [(i, k[0]) for _, i, k, _ in listed if i % 500 < 3 or i >= 10_000]
    assert found == sorted(((i, j) for i, a in kept for j, b in kept if i < j and b.startswith(a)), key=repr)


def test_numbers_follow_the_order(spark):
    table = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"), F.lit(None).cast("int").alias("number_of"))
    got = prefixes.numbered(table.repartition(6), [F.col("v")]).collect()
    assert all(r.number == r.v + 1 for r in got)
    assert prefixes.numbered(table.limit(0), [F.col("v")]).count() == 0


def test_points_inside_spans(spark):
    rng = random.Random(5)
    spans = [(i, a, a + rng.choice([0, 1, 2, 5, 60, 200])) for i, a in enumerate(rng.choices(range(300), k=80))]
    points = [(i, p) for i, p in enumerate(rng.choices(range(520), k=90))]
    found = prefixes.inside(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "s long, low long, high long"), "at", "low", "high")
    assert rows(found, "p", "s") == sorted(((p, s) for p, at in points for s, low, high in spans if low <= at < high), key=repr)
    assert prefixes.inside(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame([], "s long, low long, high long"), "at", "low", "high").count() == 0
