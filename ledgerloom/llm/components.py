"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import materialise


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each point to the smallest point of its component, for links in one task."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    label = np.arange(len(names))
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        # The root of either side, and either side itself, learn the smaller label.
        for side in (before[a], before[b], a, b):
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with; linked nodes only.

    Every round hangs each node's larger neighbours, then its smaller ones, below the
    smallest node known there. The minima are aggregated on the map side and written, so
    the joins to them have both sides of their own and adaptive execution can split a node
    with very many neighbours; rounds are about the logarithm of the longest path.
    """
    edges = materialise(
        links.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .filter("a <> b").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")), "least")
        # Large star: larger neighbours of a go below the smallest of a and its neighbours.
        large = materialise(
            both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # Small star: a's smaller neighbours and a itself go below the smallest of them.
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a <> b").distinct()
        edges_next = materialise(small, "links")
        # Done when every node hangs below exactly one node that hangs below none.
        more = edges_next.groupBy("a").count().filter("count > 1").limit(1).count()
        deep = 0 if more else edges_next.join(
            edges_next.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = edges_next
        if not more and not deep:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
