"""Connected components by contraction: every node points to the smallest node next to it, pointers are followed,
edges are redrawn between what they lead to, until none is left. Each round at least halves the nodes with edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b: bigint)."""
    left = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    label = None
    n = 0
    while left.limit(1).count():
        n += 1
        both = left.union(left.select("b", "a"))
        parent = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), f"parent{n}")
        up = parent.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        parent = scratch.keep(parent.join(up, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up")), f"hop{n}")
        to = parent.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        if label is None:
            label = parent.select("node", F.col("up").alias("component"))
        else:
            label = label.join(to, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_u", "component").alias("component"))
        label = scratch.keep(label, f"label{n}")
        moved = left.join(to, F.col("a") == F.col("_n")).select(F.col("_u").alias("a"), "b").join(to, F.col("b") == F.col("_n")).select("a", F.col("_u").alias("b"))
        scratch.drop(f"parent{n}", f"label{n - 1}")
        left = scratch.keep(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges{n}")
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
