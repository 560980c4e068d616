"""Connected components of an edge list by alternating star contractions.

Edges point from the larger node (a) to the smaller (b) throughout, so a step
needs no edges both ways: what is smaller than a node is where its edges point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def _least(edges: DataFrame) -> DataFrame:
    """(node, m): the smallest node that each node points to."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node it sees. Never more rows than ``edges``."""
    least = _least(edges)
    return edges.join(least, edges["b"] == least["node"], "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = _least(edges)
    joined = edges.join(least, edges["a"] == least["node"])
    # Each node has an edge to its smallest neighbour, which stays as it is; the ends of others move.
    return joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node that points points to one node only, which itself points nowhere: no step changes such edges."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(False).alias("met"))
    ends = down.unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast(edges.schema["b"].dataType).alias("to"), F.lit(True).alias("met")))
    nodes = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max("met").alias("met"))
    return nodes.where("low IS NOT NULL AND (met OR low <> high)").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the smallest node reached.

    Each round writes its edges to the shared folder; only a row count comes to the driver.
    """
    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    done = False
    while not done:  # what comes in is seldom all stars
        large = cut(_large_star(current), name)
        before, current = current, cut(_small_star(large), name)
        forget(large, before)
        done = _all_stars(current)
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
