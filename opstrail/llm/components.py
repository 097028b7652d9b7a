"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import kept
from opstrail.session import remove_folder


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Every node ``u`` takes the smallest of its neighbours and itself, and passes it on:
    in a large star to its larger neighbours, in a small star to the smaller ones and itself."""
    if large:
        sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = sides.filter("b > a").join(lowest, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(lowest, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(
            lowest.select(F.col("a").alias("x"), F.col("m").alias("y"))
        )
    out = out.filter("x != y")
    return out.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Each round is written to the shared folder, so nothing is recomputed from the start when
    an executor is lost. Rounds go on until no link changes: about the logarithm of the
    longest chain.
    """
    now, path = kept(spark, links.filter("a != b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        (now, path), old = kept(spark, _stars(_stars(now, True), False), "stars"), path
        remove_folder(spark, old)  # one round's links are kept, not all
        seen = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if seen == mark:
            break
        mark = seen
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
