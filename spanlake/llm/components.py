"""Distributed connected components: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def exchanged(df: DataFrame, key: str) -> DataFrame:
    """df with its key as a new expression: a join exchanges an aggregate's rows once more instead of keeping the other side's
    rows of a key in the one task that made it, which adaptive execution could not split."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def connected_components(ws: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame | None:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Minima are aggregated before the shuffle and joined back as one row a node, both sides by an exchange of their own, so
    adaptive execution deals the edges of a node with very many neighbours to several tasks. Each round is written to the
    shared folder; rounds end when the edges no longer change. None if there is no edge. Edges with a null end and loops are ignored; repeated edges count once.
    """
    a, b = F.col("a"), F.col("b")
    state = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    first = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    current, seen = ws.write(first, "edges", **state)
    if not seen["n"]:
        return None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        low = exchanged(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), "a")
        large = both.filter(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(exchanged(least, "a"), "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        new = least.select("a", F.col("m").alias("b")).unionByName(small).distinct()
        after, now = ws.write(new, "edges", **state)
        ws.drop(current)
        current, done, seen = after, now == seen, now
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return current.select(a.alias("node"), b.alias("component")).unionByName(current.select(b.alias("node"), b.alias("component")).distinct())


def extended_components(ws: Workspace, known: DataFrame | None, more: DataFrame) -> DataFrame | None:
    """Components after further edges (a, b): those between known components are components of components."""
    if known is None:
        return connected_components(ws, more)
    known = ws.write(known, "components")
    name = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    lifted = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    lifted = connected_components(ws, lifted)
    if lifted is None:
        return known
    up = lifted.select(F.col("node").alias("component"), F.col("component").alias("top"))
    # a node that no known component has, or names, is its own component so far
    alone = lifted.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone).join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
