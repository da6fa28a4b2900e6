"""Distributed connected components by alternating large-star and small-star steps.

The published scheme (Kiveris et al., 2014): a large-star step links every larger neighbour of
a node to the smallest node near it, a small-star step does so for the smaller ones, until the
edges form stars around the smallest node of each component.  A step joins edges with minima
(one row per node), so a hot centre is never gathered into a list; edges are written between steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """One row (node, component) for every node of an edge; component is the smallest node reachable.

    ``edges`` has bigint columns a and b; direction, repeats and loops do not matter, rows with a
    null end are dropped.  Without edges the result is empty.
    """
    a, b = F.col("a"), F.col("b")
    stars = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars = scratch.table(stars, f"{name}-0")
    step = 0
    while not _settled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"{name}-{step}-large")
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        moved = large.join(least, F.col("u") == F.col("c")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        stars = scratch.table(after, f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}")
        scratch.drop(f"{name}-{step}-large")
        step += 1
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one edge downward and no centre has any."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    each = ends.groupBy("node").agg(F.sum("down").alias("downs"), F.min("down").alias("centre"))
    return each.filter("downs > 1 OR (downs = 1 AND centre = 0)").limit(1).count() == 0


def forest(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (child, root), of the few nodes 0 to n - 1 of one block under its edges (p, q)."""
    root = np.arange(n)
    while len(p):
        low = np.minimum(root[p], root[q])
        after = root.copy()
        np.minimum.at(after, p, low)
        np.minimum.at(after, q, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]
