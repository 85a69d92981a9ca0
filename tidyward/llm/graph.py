"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidyward.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) -> one row per linked node: node, root (smallest of its component).

    Rounds of two steps, each a join of links with their node's smallest neighbour: the
    larger neighbours of a node, then the smaller ones, are hung to it. Rounds end when
    the links no longer change; only a count and a sum of each round reach the driver.
    A node with very many links is a skewed join key, which adaptive execution splits.
    """
    edges = store(_distinct(links.select(F.greatest("a", "b").alias("u"),
                                         F.least("a", "b").alias("v"))))
    mark = _mark(edges)
    while True:
        edges = store(_small(store(_large(edges))))
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets a link to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(
        F.col("v").alias("u"), F.least("m", "u").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, get a link to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _distinct(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))))
