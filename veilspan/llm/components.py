"""Connected components of an edge table by alternating star contraction, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.session import materialize


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    """What tells one edge table from another: rows and an order-free sum of hashes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a long, b long) the smallest node it reaches.

    Edges may repeat, point either way or be loops; rows with a null end are left out; no edges give
    no rows. A large-star step ties all larger neighbours of a node to the smallest one, a small-star
    step does so for the smaller ones. Neighbourhoods are never gathered: each step takes a minimum
    with partial aggregation and joins it back, where a hub's rows can be split."""
    now = materialize(_oriented(edges.where("a is not null and b is not null")))
    before = None
    while (state := _digest(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize(_oriented(small.select("e.a", "e.b")))
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
