"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.runtime import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), both bigint; the component is the least
    node that can be reached.

    Large and small stars by turns: every node hands its larger neighbours, then its smaller ones, to
    the least node it knows. Edges never become more than they were, and the rounds grow with the
    logarithm of the longest chain. Each round is written to the shared folder.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(links.where(F.col("a") != F.col("b")).select(most.alias("a"), least.alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return _labelled(edges)
        before = state
        edges = cut(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    larger = both.where(F.col("b") > F.col("a")).join(to, "a")
    return larger.select(F.col("b").alias("a"), F.col("to").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge has b < a."""
    to = edges.groupBy("a").agg(F.min("b").alias("to"))
    moved = edges.join(to, "a").where(F.col("b") != F.col("to")).select(F.col("b").alias("a"), F.col("to").alias("b"))
    return moved.unionByName(to.select("a", F.col("to").alias("b"))).distinct()


def _labelled(edges: DataFrame) -> DataFrame:
    """Once nothing changes every edge leads to the least node of its component."""
    pairs = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component"))
    return pairs.groupBy("node").agg(F.min("component").alias("component"))
