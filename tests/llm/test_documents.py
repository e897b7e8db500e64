"""The operators on documents, against brute force on awkward texts and on a whole small table."""

import glob
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import decontamination, language_id, mixing, near_duplicates, passages, personal_data, quality, queries, repeated_strings
from fleetgauge.session import DROP_SHUFFLES, write_once
from tests.conftest import rows
from tests.llm import brute


@pytest.fixture(scope="module", params=["awkward", "table", "empty"])
def given(request, spark, small):
    """Documents as a table and as tuples."""
    if request.param == "table":
        table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
        return table, [tuple(r) for r in table.collect()]
    listed = brute.documents() if request.param == "awkward" else []
    return spark.createDataFrame(listed, brute.SCHEMA), listed


def test_near_duplicates(given):
    table, listed = given
    assert rows(near_duplicates.near_duplicates(table, shingle=4), "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(listed)


def test_near_duplicates_in_crowded_bands(spark):
    listed = brute.documents()
    table = spark.createDataFrame(listed, brute.SCHEMA)
    found = near_duplicates.near_duplicates(table, shingle=4, crowd=2, block=2)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(listed)


@pytest.mark.parametrize("seed", [3, 4])
def test_crowded_families_of_short_texts(spark, seed):
    """A text of seven words and 150 that add one (similarity 4/5), beside 30 that add two."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(7)]
    texts = [base, *[base + [word()] for _ in range(150)], *[base + [word(), word()] for _ in range(30)]]
    listed = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(listed, "doc_id long, text string"), shingle=4, crowd=32, block=16)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(listed)
    assert found.filter("component_id = 0").count() >= 151


def test_crowded_families_of_long_texts(spark):
    """Sets that fill all registers: split by the bands they share."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    listed, centre = [], [rng.choice(vocabulary) for _ in range(640)]
    for family in range(4):
        middle = list(centre)
        for i in rng.sample(range(640), 45):
            middle[i] = rng.choice(vocabulary)
        for _ in range(6):
            text = list(middle)
            for i in rng.sample(range(640), 10):
                text[i] = rng.choice(vocabulary)
            listed.append((len(listed), " ".join(text)))
    found = near_duplicates.near_duplicates(spark.createDataFrame(listed, "doc_id long, text string"), shingle=4, crowd=3, block=4)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(listed)


def test_one_of_each_group_stays(spark):
    listed = [r for r in brute.documents() if r[0] is not None]
    kept = near_duplicates.keep_one(spark.createDataFrame(listed, brute.SCHEMA), shingle=4)
    assert kept.columns == [c.split()[0] for c in brute.SCHEMA.split(", ")]
    alone = {r[0] for r in brute.near_duplicates(listed) if r[3]}
    assert {r.doc_id for r in kept.collect()} == alone


def test_personal_data(given):
    table, listed = given
    found = {}
    for r in personal_data.personal_data(table).collect():
        found.setdefault(r.doc_id, []).append(r)
    want = {}
    for row in listed:
        want.setdefault(row[0], []).append(brute.base_spans(row[1]))
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for key, spans in want.items():
        texts = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans]
        assert sorted(map(brute.sha, texts)) == sorted(r.base_sha256 for r in found[key])
        for r in found[key]:
            listed_spans = [x for x in r.spans.split(",") if x]
            assert len(listed_spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_personal_data_at_the_edges_of_the_patterns(spark):
    texts = [
        "write to a.b+c@ex-ample.co.uk, or x@y, or @z.com, or a@b.c@d.e", "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "é😀 mail a@b.org 😀 10.0.0.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111 1111 1111 2", "tel +1 (555) 123-4567 or +44 20 or ++4 4 20 7946 0958",
        "+1.2.3.4@5.6 +12345678901234567890", "0" * 400 + "@" * 50 + "." * 50, "a@" * 300, "1.1" * 300, "+1" + "(" * 500, None, ""]
    found = {r.doc_id: r for r in personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = brute.base_spans(text)
        assert found[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), text
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(found[i].spans.split(",")) | {""}, text


def test_one_text_of_many_spans(spark):
    """Positions and what is left of a text of thousands of spans, some of them overlapping."""
    text = " ".join(f"é +1 555 {i % 900 + 100} {i % 9000 + 1000} a{i}@b.org" for i in range(4000)) + " +4111 1111 1111 1111"
    table = spark.createDataFrame([(1, text, None)], "doc_id long, text string, n_chars long")
    found = personal_data.personal_data(table).collect()[0]
    spans = brute.base_spans(text)
    assert len(spans) > 8000 and found.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    left, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in found.spans.split(","))), key=lambda x: (x[1], personal_data.KINDS.index(x[0]))):
        left.append(text[at:a] + f"<{kind.upper()}>" if a >= at else "")
        at = max(at, b)
    row = personal_data.redacted(table).collect()[0]
    assert row.text == "".join(left) + text[at:] and row.n_chars == len(row.text)


def test_reliabilities_equal_a_plain_expectation_maximisation(spark):
    draw = random.Random(5)
    counts = {}
    for _ in range(3000):
        true = draw.random() < 0.4
        votes = tuple(None if draw.random() < 0.2 else int(draw.random() < (right if true else 1 - right)) for right in (0.9, 0.8, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    voted = spark.createDataFrame([("email", *v, n) for v, n in counts.items()], "kind string, v1 int, v2 int, v3 int, n long")
    found = personal_data.reliabilities(voted).collect()[0]
    prior, t, f = 0.5, [0.8] * 3, [0.2] * 3
    for _ in range(personal_data.ROUNDS):
        chance = {}
        for votes in counts:
            yes, no = prior, 1 - prior
            for i, v in enumerate(votes):
                if v is not None:
                    yes, no = yes * (t[i] if v else 1 - t[i]), no * (f[i] if v else 1 - f[i])
            chance[votes] = yes / (yes + no)
        prior = (sum(n * chance[v] for v, n in counts.items()) + 1) / (sum(counts.values()) + 2)
        for i in range(3):
            seen = [(n * chance[v], n * (1 - chance[v]), v[i]) for v, n in counts.items() if v[i] is not None]
            t[i] = (sum(y for y, _, v in seen if v) + 1.6) / (sum(y for y, _, _ in seen) + 2)
            f[i] = (sum(x for _, x, v in seen if v) + 0.4) / (sum(x for _, x, _ in seen) + 2)
    got = [found.prior, *[found[f"{c}v{i}"] for c in "tf" for i in (1, 2, 3)]]
    assert got == pytest.approx([prior, *t, *f], abs=1e-9)
    # eight rounds do not reach the planted rates (0.82 for 0.9), but their order
    assert t[0] > t[1] > t[2] and f[0] < f[1] < f[2]


def test_redaction_takes_the_spans_out(spark):
    listed = [(1, "Mail a.b@c.org, card 4111 1111 1111 1111 ok", 9, "x"), (2, None, None, "y"), (3, "nothing here", 12, None)]
    found = {r.doc_id: r for r in personal_data.redacted(spark.createDataFrame(listed, "doc_id long, text string, n_chars long, _text string")).collect()}
    assert found[1].text == "Mail <EMAIL>, card <CARD> ok" and found[1].n_chars == len(found[1].text) and found[1]["_text"] == "x"
    assert found[2].text is None and found[2].n_chars is None and found[3].text == "nothing here"


def test_mixing(given):
    table, listed = given
    found = mixing.mixed(table).collect()
    sizes, targets = brute.targets(listed)
    assert sorted(((r.doc_id, r.size, r.source, r.source_size) for r in found), key=repr) == sorted(((r[0], len(brute.words(r[1])), r[3], sizes[r[3]]) for r in listed), key=repr)
    for source, target in targets.items():
        mine = [r for r in found if r.source == source]
        assert all(abs(r.target - target) <= 1e-6 * max(target, 1) for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
        # the awkward source of ten documents, one of them 80 % of it, ends 3.7 % off: one correction per size class
        assert abs(sum(r.taken for r in mine) - target) <= max(0.04 * target, min([r.size for r in mine if r.size] or [0]))
    assert rows(mixing.mixed(table.repartition(3)), "doc_id", "size", "taken") == sorted(((r.doc_id, r.size, r.taken) for r in found), key=repr)


def test_quality_counts(given):
    table, listed = given
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = quality.quality(table)
    assert rows(found, *columns) == sorted(((r[0], *brute.quality(r[1])) for r in listed), key=repr)
    assert found.filter("kept and (base_failed or size(failed) > 0)").count() == 0


def test_quality_thresholds_follow_the_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    listed = [(i, text + " #" * (i % 3), "en", "web") for i in range(300)] + [(900, text + " # $" * 60, "en", "web"), (901, text, "xx", None)]
    kept = quality.quality(spark.createDataFrame(listed, "doc_id long, text string, lang string, source string")).collect()
    assert [r.doc_id for r in kept if not r.kept] == [900]


def test_a_uniform_group_rejects_what_is_far_from_it(spark):
    """401 documents with 0 to 3 symbols per mille, and one with 64."""
    text = " ".join(f"word{i:04d}" for i in range(125))  # 1000 characters of words
    listed = [(i, text + " #" * (i % 4), "en", "web") for i in range(401)] + [(900, text + " #" * 68, "en", "web")]
    kept = quality.quality(spark.createDataFrame(listed, "doc_id long, text string, lang string, source string")).collect()
    assert [r.doc_id for r in kept if not r.kept] == [900]


def quality_thresholds(rows_):
    """The thresholds of each group, plainly: {(lang, source): {measure: most}}."""
    def top(bucket):
        shift = max(bucket // 16 - 1, 0)
        return ((bucket - 16 * shift + 1) << shift) - 1

    def of(value):
        shift = max(value.bit_length() - 5, 0)
        return 16 * shift + (value >> shift)

    groups = {}
    for _, text, lang, source, *_ in rows_:
        n, chars, symbols, dup, repeat, _failed = brute.quality(text)
        if n:
            lines = len([x for x in (text or "").split("\n") if brute.words(x)])
            values = {"symbols": 1000 * symbols // chars, "dup_lines": 1000 * dup // lines, "repeats": 1000 * repeat // n, "word_chars": 10 * chars // n}
            for key in ((lang, source), (lang,), ()):
                for m, v in values.items():
                    groups.setdefault(key, {}).setdefault(m, []).append(of(v))
    limits = {}
    for key, measures in groups.items():
        for m, buckets in measures.items():
            buckets.sort()
            q1, q3 = (top(buckets[-(-q * len(buckets) // 4) - 1]) for q in (1, 3))
            limits.setdefault(key, {})[m] = (q3 + 6 * max(q3 - q1, quality.LEAST_RANGE[m]), len(buckets))
    out = {}
    for key in limits:
        if len(key) == 2:
            for m, (own, n) in limits[key].items():
                (lang, ln), (every, _) = limits[key[:1]][m], limits[()][m]
                far = (lang * ln + every * 200) // (ln + 200)
                out.setdefault(key, {})[m] = (own * n + far * 200) // (n + 200)
    return out


def test_quality_thresholds(given):
    table, listed = given
    found = {(r.lang, r.source): r["_most"] for r in quality.thresholds(quality.sketches(quality.measured(table))).collect()}
    assert found == quality_thresholds(listed)


def test_sketches_merge(spark):
    listed = [r for r in brute.documents() if r[1]]
    whole, one, two = (quality.sketches(quality.measured(spark.createDataFrame(x, brute.SCHEMA))) for x in (listed, listed[::2], listed[1::2]))
    keys = ["lang", "source", "measure", "bucket"]
    merged = one.unionAll(two).groupBy(*keys).agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert rows(whole, *keys, "n") == rows(merged, *keys, "n")


def test_repeated_strings(given):
    table, listed = given
    for length, kmer in ((400, repeated_strings.KMER), (60, 20)):
        spans = repeated_strings.repeated_spans(table, length=length, kmer=kmer)
        found = repeated_strings.digest(repeated_strings.cut_repeats(table, spans))
        assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_strings(listed, length), length


def test_what_is_left_of_repeated_strings(spark):
    same = "é" * 300
    listed = [(1, "start " + same + " end"), (2, same + "x"), (3, "alone"), (4, None)]
    table = spark.createDataFrame(listed, "doc_id long, text string")
    found = {r.doc_id: r for r in repeated_strings.cleaned(repeated_strings.cut_repeats(table, repeated_strings.repeated_spans(table))).collect()}
    assert [found[i].has_repeats for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert [found[i].text for i in (1, 2, 3, 4)] == ["start  end", "x", "alone", ""]


def test_repeated_strings_in_crowded_buckets(spark):
    listed = brute.documents()
    table = spark.createDataFrame(listed, brute.SCHEMA)
    spans = repeated_strings.repeated_spans(table, length=60, kmer=20, crowd=2)
    found = repeated_strings.digest(repeated_strings.cut_repeats(table, spans))
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_strings(listed, 60)


def test_contamination(given, spark):
    table, listed = given
    texts = [r[1] for r in listed if r[1] and len(r[1]) > 200][:6]
    items = [(i, " ".join(brute.words(t)[3:20])) for i, t in enumerate(texts)] + [(50, "one"), (51, None), (52, ""), (None, "two words"), (53, "Two, words!"), (7, "three short words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontamination.BLOCK_BYTES, 64):
        found = decontamination.contamination(decontamination.find_passages(table, benchmark, block_bytes=size))
        assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(listed, items), size
    none = decontamination.contamination(decontamination.find_passages(table, benchmark.limit(0)))
    assert none.filter("n_hit > 0 or contaminated").count() == 0 and none.count() == len(listed)


def test_shared_passages(spark):
    listed = brute.documents()
    found = passages.shared_passages(spark.createDataFrame(listed, brute.SCHEMA)).collect()
    text = {r[0]: brute.words(brute.lower(r[1])) for r in listed if r[0] is not None}
    for r in found:
        if r.doc_id is None or r.other_id is None:
            continue
        a, b = text[r.doc_id][r.start:r.stop], text[r.other_id][r.other_start:r.other_stop]
        assert min(len(a), len(b)) >= 50 and r.n_equal >= 0.8 * max(len(a), len(b))
        assert len(a) == r.stop - r.start and len(b) == r.other_stop - r.other_start
    # the planted passage of 90 words: four equal copies and one with four words changed
    planted = [r[0] for r in listed if r[1] and re.search(r"\S", r[1]) and 27 <= (r[0] or 0) <= 31]
    assert {r.doc_id for r in found} | {r.other_id for r in found} >= set(planted)
    alone = {r[0] for r in listed if r[1] and len(brute.words(r[1])) < 50}
    assert not alone & {r.doc_id for r in found}


@pytest.mark.parametrize("lengths, gap", [((60, 60), 60), ((200, 200), 300), ((60, 80, 60), 60), ((200, 200, 70), 400), ((55, 300), 10)])
def test_ordered_passages_of_one_pair(spark, lengths, gap):
    """Texts of words of their own, but for exact passages in the same order in both."""
    one, two, want = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(30)], []
    for n, length in enumerate(lengths):
        want.append((len(one), len(one) + length, len(two), len(two) + length))
        same = [f"w{n}x{i}" for i in range(length)]
        one += same + [f"c{n}x{i}" for i in range(gap)]
        two += same + [f"d{n}x{i}" for i in range(gap)]
    found = passages.shared_passages(spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")).collect()
    if gap == 10:  # the longest similar part is the whole
        want = [(want[0][0], want[-1][1], want[0][2], want[-1][3])]
    assert sorted((r.other_start, r.other_stop, r.start, r.stop) for r in found) == want
    assert all(r.n_equal == sum(lengths) if gap == 10 else r.n_equal == r.stop - r.start for r in found)


def test_gaps_count_all_equal_words():
    rng = random.Random(3)
    for n, m, kinds in ((30, 40, 5), (250, 230, 300), (1, 1, 2), (300, 10, 4)):
        x, y = [rng.randrange(kinds) for _ in range(n)], [rng.randrange(kinds) for _ in range(m)]
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert passages._lcs(x, y) == table[n][m]
    x = np.arange(0, 900, 3)
    assert passages._between(np.concatenate([[1], x, [2]]), np.concatenate([[4], np.arange(900), [5]])) == len(x)


def test_chains_too_short_for_a_passage_are_not_aligned(monkeypatch):
    """Most chains are words met by chance: what their gaps have in common is not asked for."""
    def never(*_):
        raise AssertionError("gap compared")

    monkeypatch.setattr(passages, "_between", never)
    one, two = np.arange(1000, dtype=np.uint64), np.arange(5000, 6000, dtype=np.uint64)
    two[300:308], two[311:319] = one[100:108], one[112:120]
    assert passages.aligned(passages.Words(one), passages.Words(two), [100, 112], [300, 311], 8, 50, 0.8) == []
    assert passages.aligned(passages.Words(one), passages.Words(one.copy()), [100], [100], 8, 50, 0.8) == [(0, 1000, 0, 1000, 1000)]


def test_texts_go_on_alike_word_by_word():
    """Against plain loops, with words changed, added and lost."""
    rng = random.Random(5)

    def plain(x, y):
        i = j = equal = 0
        while True:
            while i < len(x) and j < len(y) and x[i] == y[j]:
                i, j, equal = i + 1, j + 1, equal + 1
            for u, v in ((1, 1), (1, 0), (0, 1), (2, 2)):
                a, b = x[i + u:i + u + 3], y[j + v:j + v + 3]
                if len(a) == 3 and a == b:
                    i, j = i + u, j + v
                    break
            else:
                return i, j, equal

    for _ in range(400):
        x = [rng.randrange(2**63) for _ in range(rng.randrange(0, 300))]
        y = list(x)
        for _ in range(rng.choice([0, 1, 3, 30])):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.choice([0, 1, 1, 2])] = [rng.randrange(9)] * rng.choice([0, 1, 2])
        begin, end = rng.randrange(len(x) + 1), rng.randrange(len(y) + 1)
        low, low2 = min(begin, len(y)), min(end, len(y))
        assert passages._extend(x, low, len(x), y, low, low2) == plain(x[low:], y[low:low2])
        run = passages._common(x, 0, y, 0, min(len(x), low2))
        assert x[:run] == y[:run] and (run == min(len(x), low2) or x[run] != y[run])


def test_longer_seeds_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(6)
    sizes = [0, 30, 50, 51, 400, 0, 49, 700, 120]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    words = rng.integers(1, 2**62, rows[-1]).astype(np.uint64)
    places = [np.sort(rng.choice(max(n - 7, 1), min(n // 20, 9), replace=False)) if n > 7 else np.zeros(0, np.int64) for n in sizes]
    spans = [[(100, 170), (300, 360)] if n >= 400 else [] for n in sizes]

    def found(rows, words, places, spans):
        return passages.seeds_around(words, rows, places, 8, spans, 50, 16, 16)

    got, at = found(rows, words, np.concatenate([p + r for p, r in zip(places, rows)]), [(s + r, e + r) for x, r in zip(spans, rows.tolist()) for s, e in x])
    each = [found(np.array([0, n]), words[r:r + n], p, x) for n, r, p, x in zip(sizes, rows, places, spans)]
    assert len(got) and got.tolist() == [v for one, _ in each for v in one.tolist()]
    assert at.tolist() == [v + r for (_, where), r in zip(each, rows.tolist()) for v in where.tolist()]
    assert all(rows[1:][np.searchsorted(rows, at, "right") - 1] >= at + 16)


def test_shuffle_files_of_a_written_table_go(spark):
    """They are not left to the driver's garbage collection, and the setting is as before."""
    def files():
        return set(glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data"))

    before, setting = files(), spark.conf.get(DROP_SHUFFLES, None)
    counted = spark.range(20_000).groupBy(F.xxhash64("id").alias("g")).count()
    again = write_once(counted, "counted", drop_shuffles=True)
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(DROP_SHUFFLES, None) == setting
    assert again.count() == counted.count() == 20_000
    write_once(counted, "counted")
    assert files() - before


def test_passages_of_an_empty_table(spark):
    assert passages.shared_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_of_held_out_texts(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, of = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert of > 100 and right >= 0.9 * of
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_without_letters_or_labels(spark):
    listed = [(1, None, "en"), (2, "12 34 !", "en"), (3, "", None), (None, "some words", None)]
    found = language_id.identify(spark.createDataFrame(listed, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in found] == ["und"] * 4 and all(r.score == 0 for r in found)
    assert language_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.llm_queries()] == [f"op{i}" for i in range(1, 14)]


def _framed(i, middle):
    """A text around a passage, all other words its own."""
    return i, " ".join([f"x{i}_{j}" for j in range(30)] + middle + [f"y{i}_{j}" for j in range(30)])


def test_pieces_before_the_whole_passage(spark):
    """Three earlier documents hold overlapping pieces too short to report; the two with the whole still meet."""
    whole = [f"p{i}" for i in range(90)]
    docs = [_framed(1, whole[:49]), _framed(2, whole[20:69]), _framed(3, whole[41:]), _framed(4, whole), _framed(5, whole)]
    for k in (4, 8):
        found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string"), k=k).collect()
        assert [(r.doc_id, r.start, r.stop, r.other_id, r.other_start, r.other_stop) for r in found] == [(5, 30, 120, 4, 30, 120)]


def test_every_common_run_of_words_is_linked(spark):
    """Against brute force: documents with 50 equal words in a row are linked, whatever pieces others hold."""
    rng = random.Random(11)
    stock = [[f"s{n}_{i}" for i in range(120)] for n in range(4)]
    docs = []
    for i in range(60):
        body = [f"own{i}"]
        for _ in range(3):
            part = rng.choice(stock)
            start, size = rng.randrange(0, 80), rng.choice([12, 30, 45, 49, 50, 51, 60, 80])
            body += part[start:start + size] + [f"own{i}_{rng.random()}" for _ in range(rng.randrange(2, 30))]
        docs.append((i, " ".join(body)))
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    group = {i: i for i, _ in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for r in found:
        group[root(r.doc_id)] = root(r.other_id)
    runs: dict = {}
    for i, text in docs:
        words = text.split()
        for j in range(len(words) - 49):
            runs.setdefault(tuple(words[j:j + 50]), set()).add(i)
    together = [ids for ids in runs.values() if len(ids) > 1]
    assert len(together) > 20
    assert all(len({root(i) for i in ids}) == 1 for ids in together)


@pytest.mark.parametrize("similarity, k", [(0.8, 4), (0.85, 4), (0.9, passages.KMER)])
@pytest.mark.parametrize("spread", ["even", "random"])
def test_recall_of_changed_passages(spark, similarity, k, spread):
    """Passages of 200 words with a share of the words changed, evenly or at random."""
    rng, docs, pairs = random.Random(4), [], 40
    for n in range(pairs):
        words = [f"{n}w{j}" for j in range(200)]
        changed = round(200 * (1 - similarity))
        at = {int((j + 0.5) * 200 / changed) for j in range(changed)} if spread == "even" else set(rng.sample(range(200), changed))
        docs += [_framed(2 * n, words), _framed(2 * n + 1, [f"c{n}_{j}" if j in at else w for j, w in enumerate(words)])]
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string"), k=k, gap=0.05).collect()
    assert all(r.doc_id == r.other_id + 1 and r.other_id % 2 == 0 for r in found)
    got = {r.doc_id for r in found if r.stop - r.start >= 100 or similarity == 0.8}
    assert len(got) >= 0.9 * pairs


def test_passages_in_rows_with_odd_ids(spark):
    """Null ids, repeated rows, one id with two texts, clashing column names."""
    whole = " ".join(f"p{i}" for i in range(70))
    docs = [(None, whole, 1), (3, whole, 2), (3, whole, 2), (3, "a b " + whole, 3), (4, None, 4), (5, "", 5), (0, whole + " z", 6)]
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string, seed long")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.other_id, r.n_equal) for r in found) == [(-1, 0, 70), (3, 0, 70), (3, 0, 70)]
