"""Whitening, periodic runs and the quality classifier against plain statements of what they mean."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fleetgauge.llm import periodic_runs, quality_model, queries, whitening
from tests.conftest import rows
from tests.llm import brute

# whitening


def grid(vector):
    if vector is None or not vector or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(float(c) * 64) + 1000000 for c in vector)


def check_whitening(found, given, components=16):
    """`given`: (vec_id, vector) rows with ids of their own."""
    kept = {i: grid(v) for i, v in given if grid(v) is not None}
    fit = sorted(set(kept.values()))
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    centred = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    exact = [[Fraction(sum(c[a] * c[b] for c in centred), n**3) for b in range(dims)] for a in range(dims)]
    cov = np.array([[float(v) for v in row] for row in exact])
    values = np.linalg.eigvalsh(cov)[::-1]
    use = [k for k in range(min(components, dims)) if values[k] > 1e-9 * values[0] > 0]
    assert len(found) == len(kept) * len(use)
    for r in found:
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(kept[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 and r.identity_error <= 1e-4
    table = {}
    for r in found:
        table.setdefault(kept[r.vec_id], {})[r.component] = r.whitened
    z = np.array([[table[x][k + 1] for k in use] for x in fit])
    assert np.abs(z.mean(axis=0)).max() < 1e-6 and np.abs(np.cov(z.T, bias=True) - np.eye(len(use))).max() < 1e-4
    # the projection is linear with unit eigenvectors: z * sqrt(e) = y @ u and V u = e u
    y = np.array(centred, float) / n
    for j, k in enumerate(use):
        u = np.linalg.lstsq(y, z[:, j] * math.sqrt(values[k]), rcond=None)[0]
        assert np.abs(cov @ u - values[k] * u).max() < 1e-6 * values[0]


def test_whitening_of_the_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    check_whitening(queries.op11_embedding_whitening(spark, small).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_of_awkward_vectors(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    base = [[a, b, c, a + b, d] for a, b, c, d, _ in base]
    vectors = base + base[:7] * 3 + [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300] + [0.0] * 4, [1.0, 2.0], [0.0] * 6, [3e3, -2e3, 5e2, 0.0, 1.0]]
    given = list(enumerate(vectors))
    table = spark.createDataFrame([(i, v, 1.0, "x", 2, None) for i, v in given], "vec_id long, embedding array<double>, n double, component string, whitened int, key string")
    right = [(i, v) for i, v in given if v is None or len(v) == 5 and v[0] != 1e300]
    check_whitening(whitening.whiten(table).collect(), right)
    check_whitening(whitening.whiten(table.repartition(7), components=2).collect(), right, 2)


def test_whitening_keeps_rows_and_directions_with_spread(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, None)], schema)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(None, [0.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])], schema)
    found = whitening.whiten(line).collect()
    assert [r.vec_id for r in found].count(7) == 2 and len(found) == 3 and {r.component for r in found} == {1}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.n == 2 and abs(r.explained - 1) < 1e-12 for r in found)


def test_deviations_of_any_size():
    for scale in (1, 2**20, 2**40):
        x = np.array([[3, -2], [5, 9], [4, 4]], np.int64) * scale
        n, sums = 3, x.sum(axis=0)
        model = whitening.Whitening(n, np.array([int(s) // n for s in sums], object), np.array([int(s) % n for s in sums], object), *[np.zeros((2, 2))] * 4)
        want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
        assert model.deviations(x) == [w if w < 2**63 else None for w in want]


# periodic runs


def brute_runs(w):
    found, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start >= max(6, 4 * q) and (start, i) not in seen:
                seen.add((start, i))
                found.append((start, i, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = []
    kinds = rng.choice([1, 2, 3, 8])
    for _ in range(rng.randint(0, 8)):
        if rng.random() < 0.6:
            period = rng.randint(1, 20)
            unit = [0] * (period - 1) + [1] if rng.random() < 0.3 else [rng.randrange(kinds) for _ in range(period)]
            w += (unit * 8)[:rng.randint(1, 7 * period)]
        else:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 9))]
    return w


def test_squares_merge_into_all_runs():
    rng = random.Random(2)
    found = 0
    for _ in range(1500):
        w = repetitive(rng)
        want = brute_runs(w)
        found += len(want)
        catchers = periodic_runs.Catchers()
        catchers.append(np.array(w, np.int64))
        assert list(map(tuple, catchers.runs().tolist())) == want, w
    assert found > 500


def test_words_appended_one_by_one_or_in_parts():
    rng = random.Random(3)
    for _ in range(150):
        w, catchers, at = repetitive(rng), periodic_runs.Catchers(), 0
        while at < len(w):
            step = rng.choice([1, 1, 2, 9, 30])
            squares = catchers.append(np.array(w[at:at + step], np.int64))
            at += step
            assert all(w[s:s + p] == w[s + p:s + 2 * p] for s, p in squares.tolist())
            if rng.random() < 0.2:
                assert list(map(tuple, catchers.runs().tolist())) == brute_runs(w[:at]), w[:at]
        assert list(map(tuple, catchers.runs().tolist())) == brute_runs(w), w


@pytest.mark.parametrize("w, want", [([0] * 5, None), ([0] * 6, None), ([0] * 5000, [(0, 5000, 1)]), ([1, 2, 3] * 2000, [(0, 6000, 3)]), (list(range(3000)) * 4, [(0, 12000, 3000)]),
                                     (([5] * 40 + [6]) * 30, None), ([bin(i).count("1") % 2 for i in range(4096)], None)])
def test_runs_of_long_and_plain_texts(w, want):
    catchers = periodic_runs.Catchers()
    catchers.append(np.array(w, np.int64))
    assert list(map(tuple, catchers.runs().tolist())) == (brute_runs(w) if want is None else want)


def contract_of_runs(doc_id, text):
    w = brute.words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    return (doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            brute.sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_documents(spark):
    listed = brute.documents() + [(100 + i, t, None, None, 0, "", "", "", "", 0, "", "") for i, t in enumerate([
        "a b " * 30 + "c", "x\ty\nz " * 9 + "x y z q", "ha " * 7 + "ho " * 6, "\x1c a \x1c a \x1c a \x1c a \x1c a", "é è é è é è é è", "é è " * 8, "a " * 3])]
    table = spark.createDataFrame(listed, brute.SCHEMA)
    found = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_tails(table)))
    assert rows(found, *COLUMNS) == sorted((contract_of_runs(r[0], r[1]) for r in listed), key=repr)
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_tails(table.limit(0)))).count() == 0


def test_runs_of_the_table(spark, small):
    listed = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 8000").select("doc_id", "text")
    found = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_tails(listed)))
    want = sorted((contract_of_runs(*r) for r in listed.collect()), key=repr)
    assert rows(found, *COLUMNS) == want and any(r[1] for r in want)
    assert queries.op12_periodic_runs(spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_runs_and_their_text(spark):
    found = periodic_runs.find_runs(spark.createDataFrame([(1, "one  two\none two one two one two three", 5)], "doc_id long, text string, runs int")).first()
    assert [tuple(r) for r in found.runs] == [(0, 8, 2)] and found.collapsed == "one two three" and found.n_words == 9


# quality classifier


def recursive_score(model, x):
    total = model.base
    for root in model.roots.tolist():
        at = root
        while model.left[at] != at:
            at = model.left[at] if x[model.statistic[at]] <= model.threshold[at] else model.right[at]
        total += model.value[at]
    return 1 / (1 + math.exp(-total))


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality_model.train(x, y, trees=20)
    assert np.allclose(model.score(x), [recursive_score(model, r) for r in x], atol=1e-12)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_a_cut_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (80, 3)).astype(float)
    y = rng.integers(0, 2, 80).astype(float)
    model = quality_model.train(x, y, trees=1, depth=1)
    p = 1 / (1 + math.exp(-model.base))
    g, h = y - p, np.full(80, p * (1 - p))

    def gain(left):
        parts = [g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)]
        return sum(parts) if min(h[left].sum(), h[~left].sum()) >= 2 else -1

    best = max(gain(x[:, f] <= c) for f in range(3) for c in range(9))
    root = model.roots[0]
    left = x[:, model.statistic[root]] <= model.threshold[root]
    assert abs(gain(left) - best) < 1e-9
    assert abs(model.value[model.left[root]] - quality_model.RATE * g[left].sum() / (h[left].sum() + 1)) < 1e-9


def test_statistics_of_texts(spark):
    texts = ["", None, "Ab cd, EF!\nab cd, ef!\nx1 $ é", "a a a a a a", " \n ", "\x00"]
    found = {r.doc_id: dict(zip(quality_model.STATISTICS, r.statistics)) for r in quality_model.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not any(found[0].values()) and not any(found[1].values())
    s = found[2]
    assert s["words"] == 9 and s["lines"] == 3 and s["distinct_words"] == 6 / 9 and s["capital_words"] == 2 / 9 and s["upper_words"] == 1 / 9
    assert s["letterless_words"] == 1 / 9 and s["marked_words"] == 3 / 9 and s["repeated_lines"] == 1 / 3 and s["bytes"] == 29 and s["digit"] == 1 / 29
    assert abs(s["characters_per_word"] - 20 / 9) < 1e-12
    assert found[3]["top_word"] == 1 and abs(found[3]["repeated_grams"] - 2 / 3) < 1e-12


def test_quality_of_held_out_documents(spark, small):
    folder = small.replace("0.001", "0.01")
    found = queries.op13_quality_classifier(spark, folder)
    listed = found.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(listed) > 40 and sum(r.predicted == r.quality for r in listed) >= 0.93 * len(listed)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in listed)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_quality_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (None, "some words", "c", 3), (1, None, "a", 1)], "doc_id long, text string, quality string, score int")
    none = spark.createDataFrame([(None, 1), (1, None), (1, 7), (99, 1)], "doc_id long, quality int")
    found = quality_model.rate_quality(docs, none).collect()
    assert len(found) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in found)
    one = spark.createDataFrame([(i, 1) for i in range(9)] * 2, "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_model.rate_quality(docs, one).collect())
    assert quality_model.rate_quality(docs.limit(0), one).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "#### $$$$ %%%%") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    found = quality_model.rate_quality(docs, labels, most=60).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in found)
