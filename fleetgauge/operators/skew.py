"""Work on groups of any size: hot keys are found, split, and put together again.

A key may hold a large part of all rows. Spark's partial aggregation deals with that for
`groupBy`, and a group limit before the shuffle deals with top-n per key. Two cases remain:
ordered windows (one task would sort the whole key) and joins back to a per-key aggregate
(one task would get the whole key, and the runtime skew join does not see through the
aggregate). Both are handled here.

Hot keys come from a frequent-items sketch over the hashes of the keys, filled where the rows are read
and merged in two steps; the fact table itself is not shuffled for it. The sketch lists at most
`SKETCH_KEYS` hashes, which is what makes its broadcast safe. A key it misses holds less than about a
thousandth of all rows and stays unsplit, and one that is listed for nothing is split for nothing: both
change cost, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


HOT_ROWS = 5_000_000
#: Most keys that are split, counters of a sketch, and groups of tasks whose sketches are merged first.
SKETCH_KEYS, SKETCH_ITEMS, SKETCH_GROUPS = 1_000, 4_096, 512
#: Most ranges or parts of one key.
MAX_PIECES = 4_096
#: Rows of the sketch of a hot key's order, per range it is cut into: ranges are then even to within
#: about a fifth.
SKETCH_ROWS = 256


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """`_hot`, the hash of a key, and `_rows`, about how many rows have it, for keys of about `hot_rows`
    rows or more. `counted` are known row counts per key (`_rows`)."""
    limit = hot_rows or HOT_ROWS
    if counted is not None:
        return (counted.filter(F.col("_rows") >= limit).select(F.xxhash64(*keys).alias("_hot"), "_rows")
                .orderBy(F.desc("_rows"), "_hot").limit(SKETCH_KEYS).groupBy("_hot").agg(F.sum("_rows").alias("_rows")))
    hashed = df.select(F.xxhash64(*keys).alias("_h"), (F.spark_partition_id() % SKETCH_GROUPS).alias("_task"))
    parts = hashed.groupBy("_task").agg(F.expr(f"approx_top_k_accumulate(_h, {SKETCH_ITEMS})").alias("_s"))
    # by a constant: an empty table has no group and no sketch
    whole = parts.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_s, {SKETCH_ITEMS})").alias("_s"))
    listed = whole.select(F.inline(F.expr(f"approx_top_k_estimate(_s, {SKETCH_KEYS})")).alias("_hot", "_rows"))
    return listed.filter(F.col("_rows") >= limit)


def _marked(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str, *columns: Column) -> DataFrame:
    """`df` beside the hot hashes, plus computed columns."""
    return df.join(F.broadcast(hot), F.xxhash64(*[df[k] for k in keys]) == hot["_hot"], how).select(*[df[c] for c in df.columns], *columns)


def _with_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str, *columns: Column) -> DataFrame:
    """`df` beside a list by key (its keys renamed to `_hot_*`), plus computed columns."""
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
    return df.join(F.broadcast(hot), cond, how).select(*[df[c] for c in df.columns], *columns)


def _named(hot: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    return hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *columns)


def _spread_columns(fact: DataFrame, keys: Sequence[str]) -> list[str]:
    """Two cheap columns that tell the rows of a key apart; more would undo column pruning."""
    cheap = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in fact.schema if f.name not in keys and isinstance(f.dataType, cheap)][:2]


def _pieces(df: DataFrame, keys: Sequence[str], hot_rows: int | None, counted: DataFrame | None) -> DataFrame:
    """The hot hashes and the number of parts that each is spread over."""
    limit = hot_rows or HOT_ROWS
    return hot_keys(df, keys, limit, counted).select("_hot", F.least(F.ceil(F.col("_rows") / limit) + 1, F.lit(MAX_PIECES)).cast("int").alias("_pieces"))


def _salted(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with `_salt`, the part of its hot key that a row belongs to, 0 for other keys."""
    cheap = _spread_columns(df, keys)
    number = (F.xxhash64(*[df[c] for c in cheap]) if cheap else F.lit(0)) + F.spark_partition_id()
    return _marked(df, hot, keys, "left", F.coalesce(F.pmod(number, F.col("_pieces")), F.lit(0)).cast("int").alias("_salt"))


def salted_join(fact: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner",
                hot_rows: int | None = None, null_safe: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Equi-join of a fact table to a lookup with few rows per key.

    Rows of a hot key (found in a pass over the key columns alone) are spread over several partitions by two of their columns and the
    number of their input partition (both the same when a task is run again), and only that
    key's lookup rows are repeated, once per piece. `how` is inner, left, left_semi or
    left_anti. NULL keys match only if `null_safe`. `counted` are known row counts per key
    (`_rows`).
    """
    keys = list(keys)
    hot = _pieces(fact, keys, hot_rows, counted)
    left = _salted(fact, hot, keys)
    every = F.sequence(F.lit(0), F.coalesce(F.col("_pieces") - 1, F.lit(0)))
    right = (_marked(lookup, hot, keys, "left", F.explode(every).alias("_r_salt"))
             .withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    same = [left[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else left[k] == right[f"_r_{k}"] for k in keys]
    cond = reduce(lambda a, b: a & b, same, left["_salt"] == right["_r_salt"])
    return left.join(right, cond, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def attach_group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                 hot_rows: int | None = None) -> DataFrame:
    """Each row with aggregates of its group: pre-aggregate, then join back.

    NULL keys form a group of their own, as they do in a window partition.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in aggs.items()])
    joined = salted_join(df, stats.drop("_rows"), keys, "inner", hot_rows, True, stats.select(*keys, "_rows"))
    return joined.select(*df.columns, *aggs)


@dataclass
class Scan:
    """What an ordered pass should carry.

    `by`: extra grouping inside the entity. `previous`: output -> column of the row before.
    `prior_max`: output -> column whose largest value before the row is wanted. `prior_sum`: output ->
    column whose sum before the row is wanted. `prior_known`: output -> column whose latest value that
    is not NULL before the row is wanted.
    """

    previous: Mapping[str, str] = field(default_factory=dict)
    prior_max: Mapping[str, str] = field(default_factory=dict)
    prior_sum: Mapping[str, str] = field(default_factory=dict)
    prior_known: Mapping[str, str] = field(default_factory=dict)
    by: Sequence[str] = ()

    def kinds(self) -> list[tuple[str, Mapping[str, str]]]:
        return [("max", self.prior_max), ("sum", self.prior_sum), ("known", self.prior_known)]


def range_starts(df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SKETCH_ROWS) -> DataFrame:
    """Hot keys with `_starts`: where each range of their order after the first begins. `hot` has hashes
    of keys, `_pieces` wanted and about how many rows (`_count`) each has.

    The sketch of a key is what a hash of the order columns picks of its rows, with counts; it can be
    taken in parts and merged by adding, and its size follows from the number of ranges. Ranges are cut
    where its running count passes a multiple of a range's share: by time, and inside equal times by the
    columns behind it, so neither a far-off time nor a crowded one makes a range large. Rows that are
    equal in all order columns stay together.
    """
    keys, order = list(keys), list(order)
    spot = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    share = F.least(F.lit(1.0), F.col("_pieces") * rows / F.col("_count"))
    picked = _marked(df, hot, keys, "inner", F.col("_pieces"), share.alias("_share"))
    picked = picked.filter(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    sketch = picked.groupBy(*keys, "_pieces", spot.alias("_spot")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    sketch = sketch.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)})
    part = lambda upto: F.floor(upto * F.col("_pieces") / F.col("_all"))
    starts = sketch.filter((F.col("_before") > 0) & (part(F.col("_before")) < part(F.col("_before") + F.col("_n"))))
    return starts.groupBy(*keys).agg(F.array_sort(F.collect_list("_spot")).alias("_starts"))


def _place(starts: Column, spot: Column) -> Column:
    """How many of the sorted `starts` are not after `spot`, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MAX_PIECES.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(starts)) & (F.get(starts, at + step - 1) <= spot), at + step).otherwise(at))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Sequence[Scan],
                 hot_rows: int | None = None, piece: str | None = None) -> DataFrame:
    """Previous-row values, prior maxima, sums and known values per key in the given order (NULLs first).

    A hot key is cut into even ranges of its order (`range_starts`). Each range is a window
    partition of its own and starts with one seed row that carries what the ranges before
    it left behind; the seeds are an aggregate with at most one row per range and group.
    Everything runs in one shuffle, on (keys, range). `piece` names a column for the number of the
    range (0 for keys that are not cut); the result stays dealt out by keys and range.
    """
    keys, order = list(keys), list(order)
    limit = hot_rows or HOT_ROWS
    pieces = F.least(F.ceil(F.col("_rows") / limit) * 4, F.lit(MAX_PIECES))
    starts = range_starts(df, hot_keys(df, keys, limit).select("_hot", pieces.alias("_pieces"), F.col("_rows").alias("_count")), keys, order)
    hot = _named(starts, keys, F.col("_starts"))
    # cold keys have no ranges and stay whole
    spot = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    number = F.when(F.col("_starts").isNotNull(), _place(F.col("_starts"), spot) + 1).otherwise(0).cast("int")
    parts = [_with_hot(df, hot, keys, "left", number.alias("_piece"), F.lit(0).alias("_seed"))]
    cut = _with_hot(df, hot, keys, "inner", number.alias("_piece"))
    parts += [_seeds(cut, keys, order, scan, df, n) for n, scan in enumerate(scans, start=1)]
    seeded = reduce(lambda a, b: a.union(b), parts)

    outputs = []
    for n, scan in enumerate(scans, start=1):
        # seeds come before the rows, the scan's own seed last: the row before the first row is
        # that seed, or the seed of another scan, which counts as nothing
        seed = F.col("_seed")
        own = seed.isin(0, n)
        window = Window.partitionBy(*keys, "_piece", *scan.by).orderBy(
            seed == 0, seed == n, *[F.col(c).asc_nulls_first() for c in order])
        if scan.previous:
            carried = F.struct(*[F.col(c).alias(o) for o, c in scan.previous.items()])
            before = F.lag(F.when(own, carried)).over(window)
            outputs += [before.getField(o).alias(o) for o in scan.previous]
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        over = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "known": lambda c: F.last(c, ignorenulls=True)}
        for kind, wanted in scan.kinds():
            outputs += [over[kind](F.when(own, F.col(c))).over(frame).alias(out) for out, c in wanted.items()]
    kept = [F.col("_piece").alias(piece)] if piece else []
    return (seeded.select(*df.columns, "_seed", *kept, *outputs)
            .filter(F.col("_seed") == 0).drop("_seed"))


def _seeds(pieces: DataFrame, keys: list[str], order: list[str], scan: Scan,
           template: DataFrame, number: int) -> DataFrame:
    """One row per range and group: the last row, and the maxima, sums and known values of all ranges before it."""
    wanted = [set(scan.previous.values()), *[set(m.values()) for _, m in scan.kinds()]]
    if sum(map(len, wanted)) > len(set().union(*wanted)):
        raise ValueError("a column is carried in one way only within one scan")
    group = [*keys, *scan.by]
    place = F.struct(*order)
    fold = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "known": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place))}
    aggs = [fold[kind](c).alias(f"_{kind}_{c}") for kind, columns in scan.kinds() for c in dict.fromkeys(columns.values())]
    carried = list(dict.fromkeys(scan.previous.values()))
    if carried:
        aggs.append(F.max_by(F.struct(*carried), place).alias("_tail"))
    tails = pieces.groupBy(*group, "_piece").agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    earlier = (Window.partitionBy(*group).orderBy("_piece")
               .rowsBetween(Window.unboundedPreceding, -1))
    columns = {c: F.last("_tail").over(earlier).getField(c) for c in carried}
    again = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "known": lambda c: F.last(c, ignorenulls=True)}
    for kind, named in scan.kinds():
        for c in dict.fromkeys(named.values()):
            columns[c] = again[kind](F.col(f"_{kind}_{c}")).over(earlier)
    first = F.row_number().over(Window.partitionBy(*group).orderBy("_piece")) == 1
    filled = tails.select(*group, "_piece", first.alias("_first"),
                          *[v.alias(f"_s_{c}") for c, v in columns.items()])
    out = []
    for f in template.schema:
        if f.name in group:
            out.append(F.col(f.name))
        elif f.name in columns:
            out.append(F.col(f"_s_{f.name}").cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return filled.filter(~F.col("_first")).select(*out, "_piece", F.lit(number).alias("_seed"))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
             ties: bool = False, out: str = "rn") -> DataFrame:
    """First n rows per key. Spark cuts every map partition to n rows per key before the
    shuffle, so a hot key sends n rows per input partition and no more."""
    window = Window.partitionBy(*keys).orderBy(*order)
    rank = F.rank() if ties else F.row_number()
    return df.withColumn(out, rank.over(window)).filter(F.col(out) <= n)


def top_candidates(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int | None = None,
                   counted: DataFrame | None = None) -> DataFrame:
    """The rows that tie for first in their part of a key, so all that tie for first of the key and, of a hot
    key, some others. Rows are cut before the shuffle, and those of a hot key go to several tasks."""
    keys = list(keys)
    salted = _salted(df, _pieces(df, keys, hot_rows, counted), keys)
    return top_rows(salted, [*keys, "_salt"], order, 1, ties=True).select(*df.columns)
