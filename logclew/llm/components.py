"""Connected components by alternating large and small stars, on staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclew.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    larger = both.where(F.col("b") > F.col("a")).join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = edges.join(least, "a").where(F.col("b") != F.col("m"))
    return (
        smaller.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    mark = F.bit_xor(F.xxhash64("a", "b"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a that has a link and is not the least of its component;
    b is that least node.

    ``edges`` has two columns of one orderable type. Links of a node with itself and
    repeated links do nothing. Every round is written to the shared folder; their number
    grows with the logarithm of a component's width. Only a count and a checksum
    of the edges come to the driver.
    """
    first, second = edges.columns
    low, high = F.least(first, second), F.greatest(first, second)
    now = stage(
        edges.where(F.col(first) != F.col(second)).select(high.alias("a"), low.alias("b")).distinct(),
        "links",
    )
    before, state = None, _state(now)
    while state != before and state[0]:
        now = stage(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
    return now
