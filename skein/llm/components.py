"""Distributed union-find: connected components of an edge table by alternating large and small stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node on its smallest one (large star), then the smaller ones (small star);
    the rounds grow with the logarithm of the longest path. Minima are pre-aggregated before they are shuffled, so that a node
    with very many neighbours is one row a task; its own edges are rows of a join that Spark may split. Every round is
    written to the shared folder. Nothing is collected but a count and a checksum of the edges.

    Self-loops, repeated edges and nulls are ignored; no edges give an empty table."""
    u, v = F.greatest(a, b), F.least(a, b)
    edges = materialise(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    before = None
    while (now := _signature(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, edges = edges, materialise(small.distinct())
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
