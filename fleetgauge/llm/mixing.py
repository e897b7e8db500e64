"""Mixing sources to target weights by entropy balancing.

Every source has a target of words. Of all document rates between 0 and `most` copies that reach
the targets, the ones of largest entropy are wanted: minimise the sum of r ln r + (m - r) ln (m - r)
under one constraint on words per source. The dual is convex with one multiplier per source, and
its optimum tilts the rates exponentially, r = m / (1 + exp(-lambda z)) with z the size of the
document by the mean size of a word's document. Newton rounds on the dual are aggregates over
(source, size) counts, guarded by a bracket. Rates are then rounded into whole copies by
systematic rounding in order of size, with distributed running totals.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.quality import bucket
from fleetgauge.session import write_once

WEIGHTS = (5, 2, 1)
#: Words of the mix per hundred words of the corpus, and most copies of a document.
PERCENT, MOST = 150, 2
MAX_ROUNDS, PRECISION = 40, 1e-10
#: Rates are whole millionths from here on, so running totals are exact.
UNIT = 1_000_000
#: Parts that documents of one source and about one size are split into.
SALTS = 32
#: Above this many sources their table is joined by shuffle.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _group(source: Column) -> Column:
    """A key that is not null: null sources are a group of their own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """One row per source: g, source_size, target.

    Weights go round the sources in code point order, null last. Targets are the weight times one
    level, at most `most` times the source: sources are filled in order of the level at which
    they are full, and the level is where the whole is reached. One row per source is sorted.
    """
    per = sized.groupBy("g").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ordered = per.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    ordered = ordered.withColumn("w", F.get(table, (F.col("_i") % len(weights)).cast("int")))
    full = F.col("source_size") * most
    by_level = Window.orderBy(full / F.col("w"), "_i")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy())
    # level if this source and all later ones are open: num / (100 den)
    num = percent * whole - 100 * F.coalesce(F.sum(full).over(before), F.lit(0))
    levelled = ordered.withColumn("_num", num).withColumn("_den", F.sum("w").over(after))
    # the first source that the level does not fill
    is_open = full * 100 * F.col("_den") >= F.col("_num") * F.col("w")
    first = F.min(F.when(is_open, F.struct((full / F.col("w")).alias("l"), "_i", "_num", "_den"))).over(Window.partitionBy())
    levelled = levelled.withColumn("_first", first)
    share = (F.col("w") * F.col("_first._num")).cast("double") / (100 * F.col("_first._den")).cast("double")
    return levelled.select("g", "source", "source_size", F.coalesce(F.least(full.cast("double"), share), F.lit(0.0)).alias("target"))


def multipliers(sized: DataFrame, wanted: DataFrame, most: int = MOST, rounds: int = MAX_ROUNDS, precision: float = PRECISION) -> DataFrame:
    """`wanted` with `scale` (size of a word's document) and `tilt`, the optimum of the dual.

    A source with a target of 0 or of all its copies has no finite optimum: its tilt is null and
    its rates are 0 or `most`.
    """
    counts = write_once(sized.filter("size > 0").groupBy("g", "size").agg(F.count("*").alias("n")), "size-counts")
    scale = counts.groupBy(F.col("g").alias("_g")).agg((F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = wanted.join(scale, wanted["g"] == scale["_g"], "left").drop("_g")
    inner = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    start = F.log(F.col("target") / (most * F.col("source_size") - F.col("target")))
    state = write_once(state.withColumn("tilt", F.when(inner, start)).withColumn("low", F.when(inner, F.lit(-1e6))).withColumn("high", F.when(inner, F.lit(1e6))).withColumn("off", F.lit(1.0)), "tilts")
    for _ in range(rounds):
        now = state.filter("tilt is not null").select(F.col("g").alias("_g"), F.col("scale").alias("_scale"), F.col("tilt").alias("_tilt"))
        z = F.col("size") / F.col("_scale")
        share = 1 / (1 + F.exp(-F.col("_tilt") * z))
        words = F.col("n") * F.col("size") * most
        sums = counts.join(_small(now), counts["g"] == now["_g"]).groupBy("_g").agg(F.sum(words * share).alias("_sum"), F.sum(words * share * (1 - share) * z).alias("_slope"))
        moved = state.join(_small(sums), state["g"] == sums["_g"], "left")
        short = F.col("_sum") < F.col("target")
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + (F.col("target") - F.col("_sum")) / F.when(F.col("_slope") > 0, F.col("_slope"))
        middle = (low + high) / 2
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        error = F.abs(F.col("_sum") - F.col("target")) / F.col("target")
        good = error <= precision
        moved = moved.select("g", "source", "source_size", "target", "scale", F.when(good, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"), low.alias("low"), high.alias("high"), F.when(F.col("_sum").isNotNull(), error).otherwise(F.lit(0.0)).alias("off"))
        state = write_once(moved, "tilts")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= precision:
            break
    # the last digits depend on the order of sums; reruns must agree
    return state.select("g", "source", "source_size", "target", "scale", F.round("tilt", 7).alias("tilt"))


def _rounded(rows: DataFrame, most: int) -> DataFrame:
    """Whole copies from `rate` (millionths): each source's running total, in order of size, is
    cut at whole numbers. Totals run over (source, size class, salt) cells first, then inside."""
    placed = rows.withColumn("cell", F.when(F.col("size") > 0, bucket(F.col("size"))).otherwise(F.lit(-1).cast("long"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)))
    cells = placed.groupBy("g", "cell", "salt").agg(F.sum("rate").alias("sum"))
    order = Window.partitionBy("g").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("g").alias("_g"), F.col("cell").alias("_cell"), F.col("salt").alias("_salt"), F.coalesce(F.sum("sum").over(order), F.lit(0)).alias("start"))
    joined = placed.join(starts, (placed["g"] == starts["_g"]) & (placed["cell"] == starts["_cell"]) & (placed["salt"] == starts["_salt"]))
    inside = Window.partitionBy("g", "cell", "salt").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("start") + F.sum("rate").over(inside)
    # half a copy ahead: what is left over at the end is rounded, not cut off
    half = UNIT // 2
    copies = F.floor((upto + half) / UNIT) - F.floor((upto - F.col("rate") + half) / UNIT)
    number = F.row_number().over(Window.partitionBy("g", "cell", "salt").orderBy("size", "doc_id"))
    return joined.withColumn("copies", F.least(copies.cast("long"), F.lit(most).cast("long"))).withColumn("pos", number).drop("_g", "_cell", "_salt", "start")


def _corrections(rounded: DataFrame, most: int) -> DataFrame:
    """Single copies added or taken away, at most one document of each size class and direction
    per source, largest first, wherever that brings the source nearer to its target."""
    place = F.struct("size", "cell", "salt", "pos")
    per_cell = rounded.groupBy("g", "cell").agg(
        F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"),
        F.min(F.when(F.col("copies") < most, place)).alias("up"), F.max(F.when(F.col("copies") > 0, place)).alias("down"))
    steps = F.array_compact(F.flatten(F.collect_list(F.array(F.when(F.col("up.size") > 0, F.struct(F.col("up.size").alias("size"), F.lit(1).alias("sign"), "up")), F.when(F.col("down.size") > 0, F.struct(F.col("down.size").alias("size"), F.lit(-1).alias("sign"), F.col("down").alias("up")))))))
    per_source = per_cell.groupBy("g").agg((F.first("target") - F.sum("taken")).alias("gap"), F.sort_array(steps, asc=False).alias("steps"))
    start = F.struct(F.col("gap").alias("gap"), F.expr("cast(array() as array<struct<cell:bigint,salt:bigint,pos:int,sign:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        after = a["gap"] - x["sign"] * x["size"]
        same_place = F.exists(a["out"], lambda o: (o["cell"] == x["up"]["cell"]) & (o["salt"] == x["up"]["salt"]) & (o["pos"] == x["up"]["pos"]))
        better = (F.abs(after) < F.abs(a["gap"])) & ~same_place
        one = F.struct(x["up"]["cell"].alias("cell"), x["up"]["salt"].cast("bigint").alias("salt"), x["up"]["pos"].alias("pos"), x["sign"].alias("sign"))
        return F.struct(F.when(better, after).otherwise(a["gap"]).alias("gap"), F.when(better, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    flips = per_source.select(F.col("g").alias("_g"), F.explode(F.aggregate("steps", start, step, lambda a: a["out"])).alias("x"))
    return flips.select("_g", F.col("x.cell").alias("_cell"), F.col("x.salt").alias("_salt"), F.col("x.pos").alias("_pos"), F.col("x.sign").alias("_sign"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
          percent: int = PERCENT, most: int = MOST, carry: bool = False) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target (of its source), copies, taken
    (copies times size), and with `carry` the whole row as `_row`.

    Null and empty texts have size 0 and are taken 0 times. Null sources are one source, last in
    order. Repeated rows are documents each; a null id sorts first. An empty table gives no rows;
    a corpus without words has targets of 0. Reruns agree.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")]
    sized = write_once(docs.select(*columns).withColumn("g", _group(F.col("source"))), "sizes")
    tilts = multipliers(sized, write_once(targets(sized, weights, percent, most), "targets"), most).withColumnRenamed("g", "_tg").drop("source")
    tilts = _small(tilts)

    def rounded(rows: DataFrame) -> DataFrame:
        return _rounded(rows.join(tilts, rows["g"] == tilts["_tg"]).withColumn("rate", rate), most)

    share = F.when(F.col("tilt").isNotNull(), 1 / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))).when(F.col("target") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") > 0, F.round(share * most * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    plain = write_once(rounded(sized), "rounded")
    flips = write_once(_corrections(plain, most), "corrections")
    rows = rounded(docs.select(*columns, F.struct("*").alias("_row")).withColumn("g", _group(F.col("source")))) if carry else plain
    same = (F.col("g") == F.col("_g")) & (F.col("cell") == F.col("_cell")) & (F.col("salt") == F.col("_salt")) & (F.col("pos") == F.col("_pos"))
    done = rows.join(flips, same, "left").withColumn("copies", F.col("copies") + F.coalesce("_sign", F.lit(0)))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["_row"] if carry else []))
