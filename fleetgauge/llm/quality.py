"""Quality rules: fixed base rules, and thresholds that follow each language and source.

All measures are whole numbers. Each is counted into a log-linear histogram (sixteen buckets per
doubling), a quantile sketch that merges by adding counts and does not depend on order: one per
language and source, merged into one per language and one over all, which have their say the more the
smaller a group is. A document fails where a measure lies far outside what its group shows.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import write_once

#: Shortest text, and the share of repeated words, of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A group of this many documents speaks half for itself and half like its language, a language half like all
#: documents; the share grows with the group, without a step.
HALF_GROUP = 200
#: A threshold lies this many times the range of quartiles above the third. The range counts as at least so
#: much: what is normal is not rejected because a group is uniform.
SPREAD = 6
LEAST_RANGE = {"symbols": 8, "dup_lines": 60, "repeats": 45, "word_chars": 10}
#: Above this many rows the table of thresholds is not broadcast.
BROADCAST_ROWS = 20_000

SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs without ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Number of words in runs of `width` words that are found twice or more, the first included."""

    def covered(grams: Column) -> Column:
        numbered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def of(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k - 1)["g"] == x["g"], F.lit(False))
                             | F.coalesce(F.get(ordered, k + 1)["g"] == x["g"], F.lit(False)))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).cast("long").alias("n")), lambda a: a["n"])

        return _let(numbered, of)

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width)))
        return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(_let(hashes, of_hashes))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_q`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(lines, lambda rows: F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"), F.size(rows).cast("long").alias("n_lines")))

    return docs.withColumn("_q", _let(words_of(F.col(text)), counts))


def _measures() -> Column:
    """Whole-number measures of a document, by name: per mille, and tenths of a character per word."""
    q = {k: F.col(f"_q.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}

    def ratio(a: Column, b: Column, scale: int) -> Column:
        return F.when(b > 0, F.floor(a * scale / b).cast("long")).otherwise(F.lit(0).cast("long"))

    return F.create_map(
        F.lit("symbols"), ratio(q["n_symbols"], q["word_chars"], 1000), F.lit("dup_lines"), ratio(q["n_dup_lines"], q["n_lines"], 1000),
        F.lit("repeats"), ratio(q["n_repeat_words"], q["n_words"], 1000), F.lit("word_chars"), ratio(q["word_chars"], q["n_words"], 10))


def bucket(value: Column) -> Column:
    """Log-linear bucket: exact below 32, then sixteen to each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return (16 * shift + F.call_function("shiftright", value, shift)).cast("long")


def bucket_top(number: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.greatest(F.floor(number / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", number - 16 * shift + 1, shift) - 1


def sketches(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts per language, source and measure, from `measured` documents that pass no test
    yet; documents without a word say nothing."""
    rows = docs.filter("_q.n_words > 0").select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.explode(_measures()).alias("measure", "value"))
    return rows.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, half_group: int = HALF_GROUP, spread: int = SPREAD) -> DataFrame:
    """Largest accepted value of each measure, as one map `_most` per language and source: of the group itself,
    its language and all documents, weighted by size."""
    least = F.create_map(*[F.lit(x) for pair in LEAST_RANGE.items() for x in pair])
    levels = []
    for keys in (["lang", "source"], ["lang"], []):
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*keys, "measure").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        total = Window.partitionBy(*keys, "measure")
        placed = merged.select(*keys, "measure", bucket_top(F.col("bucket")).alias("top"), F.sum("n").over(order).alias("upto"), F.sum("n").over(total).alias("of"))
        quartile = [F.min(F.when(4 * F.col("upto") >= q * F.col("of"), F.col("top"))).alias(f"q{q}") for q in (1, 3)]
        found = placed.groupBy(*keys, "measure").agg(*quartile, F.max("of").alias("of"))
        most = F.col("q3") + spread * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")].cast("long"))
        levels.append(found.groupBy(*keys).agg(F.max("of").alias("_docs"), F.map_from_entries(F.collect_list(F.struct("measure", most.alias("most")))).alias("_most")))
    own, by_lang, overall = levels
    by_lang = by_lang.select(F.col("lang").alias("_l"), F.col("_docs").alias("_ld"), F.col("_most").alias("_lm"))
    whole = overall.select(F.col("_most").alias("_all"))
    joined = own.join(by_lang, own["lang"].eqNullSafe(by_lang["_l"]), "left")
    # the sketch over all documents is one row
    joined = joined.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_1", F.lit(1))), F.col("_one") == F.col("_1"), "left")

    def blend(near: Column, far: Column, size: Column) -> Column:
        return F.floor((near * size + far * half_group) / (size + half_group)).cast("long")

    mixed = F.transform_values("_most", lambda k, v: blend(v, blend(F.col("_lm")[k], F.col("_all")[k], F.col("_ld")), F.col("_docs")))
    return joined.select("lang", "source", mixed.alias("_most"))


def judged(docs: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """`measured` documents joined with their group's thresholds: adds base_failed, failed (the
    measures over their threshold) and kept."""
    limits = limits.select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), "_most")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = docs.join(limits, F.col(lang).cast("string").eqNullSafe(limits["_gl"]) & F.col(source).cast("string").eqNullSafe(limits["_gs"]), "left")
    base = (F.col("_q.n_words") < MIN_WORDS) | (100 * F.col("_q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q.n_words"))
    over = F.map_keys(F.map_filter(_measures(), lambda k, v: v > F.coalesce(F.col("_most")[k], F.lit(2**62))))
    return (joined.withColumn("base_failed", base).withColumn("failed", F.array_sort(over))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_gl", "_gs", "_most"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document row: doc_id, the counts, base_failed, failed measures and kept.

    A null, empty or blank text has zero counts and fails the base rule. Null languages and
    sources are groups of their own. Repeated rows are counted and judged each; columns that are
    not named are not read. An empty table gives no rows.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    counts = write_once(measured(plain).drop("text"), "quality")
    rows = judged(counts, write_once(thresholds(sketches(counts)), "thresholds"))
    return rows.select("doc_id", *[F.col(f"_q.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "failed")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `quality` keeps, with all their columns."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    # measured once, beside the rows: two passes read it
    counts = write_once(measured(packed).drop("text"), "measured")
    return judged(counts, write_once(thresholds(sketches(counts)), "thresholds")).filter("kept").select("_row.*")
