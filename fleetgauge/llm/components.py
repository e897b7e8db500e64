"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import write_once


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join every node's neighbours to the smallest of them and itself: the larger neighbours
    (large star), or the smaller ones and the node (small star). One row per edge throughout;
    a node with very many edges is spread by the runtime skew join, as it is a join of the
    edges with one pre-aggregated row per node."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    joined = both.join(low, both["u"] == low["_u"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the smallest node reachable) of every node with an edge.

    `edges` has columns u and v of any ordered type; direction, repeats and loops don't matter;
    a null end is an error of the caller. Each round is written to the shared folder.
    """
    edges = write_once(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        edges = write_once(_star(_star(edges, True), False), "edges")
        # the rounds are done when every node points at one smaller node which points at none
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


