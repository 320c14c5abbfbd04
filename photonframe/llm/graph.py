"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """edges (u, v), u > v; the new edges and the table of the least ones. A step links neighbours of a node to the least of its
    neighbourhood: the larger neighbours (large star) or the smaller ones (small star).
    The least ones are written first: both sides of the join are then read as they are, so
    that Spark can split the edges of a node that has very many."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        new = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        both = edges.join(least, "u")
        new = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u > v").distinct(), least


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an undirected edge table (a, b); component is the
    least node. Each round is two aggregations and joins by node; its edges are written to
    the shared folder. Loops, repeated edges and both directions are allowed; rows with a
    null end are left out; an empty table gives no rows."""
    a, b = (F.col(c).cast("long") for c in ("a", "b"))
    now = edges.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "edges")
    seen = None
    for _ in range(rounds):
        before = [now]
        for large in (True, False):
            new, least = _star(before[-1], large)
            before += [least, materialize(new, "edges")]
        now = before.pop()
        discard(*before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
