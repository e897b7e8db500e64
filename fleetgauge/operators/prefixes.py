"""Which lists begin with which others, as numbers instead of pairs.

All different lists of a table are sorted once, each twice: as it is, and followed by an element
above all others. In that order the two places of a list enclose the places of exactly those lists of its
group that begin with it. The pair of numbers (`entry`, `exit`) labels the list like a node of a prefix
tree: p is a proper prefix of q if p.entry < q.entry < p.exit. The table has one row per list,
whatever the number of pairs, and every pair can be read from it by a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.session import write_once

#: Sorts behind every text and list element in use.
LAST = "\U0010ffff"


def numbered(df: DataFrame, order: Sequence[Column], out: str = "number") -> DataFrame:
    """Rows with their place (from 1) in a total order, without any task seeing more than a range.

    The rows are cut into ranges and sorted inside them; the sizes of the ranges, one row each, give where
    each one starts. Rows that are equal in `order` get different numbers in no certain order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_once(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    # one row per range: the window over all of them is small
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
            .select(*df.columns, (F.col("_start") + F.col("_at") + 1).alias(out)))


def prefix_tree(lists: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """One row per group and different list (an array of texts, or a text): `entry`, `exit`, and
    `longer`, the number of lists of the group that begin with it and go on.

    A text begins with another character by character, an array element by element. Null lists are
    left out; an empty list begins all others of its group. Null group keys are a group.
    """
    group = list(group)
    distinct = lists.filter(F.col(column).isNotNull()).select(*group, column).distinct()
    isarray = isinstance(lists.schema[column].dataType, T.ArrayType)
    behind = F.concat(F.col(column), F.array(F.lit(LAST)) if isarray else F.lit(LAST))
    twice = distinct.select(*group, column, F.explode(F.array(F.struct(F.col(column).alias("_s"), F.lit(False).alias("_end")), F.struct(behind.alias("_s"), F.lit(True).alias("_end")))).alias("_e"))
    twice = twice.select(*group, column, "_e._s", "_e._end")
    # a list that ends with LAST itself stands before another list's end at the same place
    placed = numbered(twice, [*[F.col(g) for g in group], F.col("_s"), F.col("_end")], "_at")
    tree = placed.groupBy(*group, column).agg(F.min("_at").alias("entry"), F.max("_at").alias("exit"))
    return write_once(tree.withColumn("longer", F.expr("(exit - entry - 1) div 2")), "prefixes")


def blocks_of(low: Column, high: Column, levels: int) -> Column:
    """The numbers from `low` up to, not including, `high` as blocks [k * 2^l, (k + 1) * 2^l): an array
    of (level, block), at most two of each level."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first, end = F.call_function("shiftright", low + size - 1, level), F.call_function("shiftright", high, level)
        return F.array(F.when((first < end) & (first % 2 == 1), F.struct(level.alias("level"), first.cast("long").alias("block"))),
                       F.when((first < end) & (end % 2 == 1), F.struct(level.alias("level"), (end - 1).cast("long").alias("block"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def inside(points: DataFrame, spans: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Pairs of a row of `points` and a row of `spans` with low <= point < high, by equality of blocks.

    Each span is cut into few blocks of doubling size, each point lies in one block of every
    size that occurs; so only pairs of the result meet, however many rows share a group.
    """
    top = spans.agg(F.max(F.col(high) - F.col(low))).first()[0] or 1
    levels = max(int(top).bit_length(), 1)
    cut = spans.withColumn("_b", F.explode(blocks_of(F.col(low), F.col(high), levels)))
    cut = cut.withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())
    every = F.explode(F.array(*[F.lit(u) for u in used]) if used else F.array().cast("array<int>"))
    where = points.withColumn("_pl", every).withColumn("_pb", F.call_function("shiftright", F.col(point), F.col("_pl")))
    return where.join(cut, (F.col("_pl") == F.col("_level")) & (F.col("_pb") == F.col("_block"))).drop("_pl", "_pb", "_level", "_block")
