"""Connected components by alternating large-star and small-star rounds.

The graph is given as memberships; each group is a star around its smallest
member, so the input is linear in the memberships and no pair is formed.  Rounds
grow with the logarithm of the graph size (Kiveris et al., SoCC 2014).  Every
round is written to the checkpoint folder.

The rounds of a graph that is counted to have at most ``one_task`` edges run in one
partition and broadcast at most as many minima, so they exchange nothing: on many
partitions such a round is hundreds of empty tasks.  Rounds never add edges.  The
result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.session import cut


def _union(a: DataFrame, b: DataFrame, one: bool) -> DataFrame:
    both = a.unionByName(b)
    return both.coalesce(1) if one else both


def _is_stars(e: DataFrame, one: bool) -> bool:
    """True when every node hangs off one root and no root hangs off another."""
    sides = _union(
        e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")),
        e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")),
        one,
    )
    roles = sides.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return roles.where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _large_star(e: DataFrame, one: bool) -> DataFrame:
    both = _union(e, e.select(F.col("v").alias("u"), F.col("u").alias("v")), one)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(F.broadcast(low) if one else low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(e: DataFrame, one: bool = False) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(F.broadcast(low) if one else low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _union(linked, low.select("u", F.col("m").alias("v")), one).distinct()


def components(stars: DataFrame, one_task: int = 0) -> DataFrame:
    """(node, component) of the edges ``stars(u, v)``; the smallest node names it."""
    e = cut(_small_star(stars))
    one = one_task > 0 and e.count() <= one_task
    if one:
        e = e.coalesce(1)
    while not _is_stars(e, one):
        e = cut(_small_star(_large_star(e, one), one))
        if one:
            e = e.coalesce(1)
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def group_stars(m: DataFrame) -> DataFrame:
    """Memberships as edges from each member to the smallest member of its group."""
    low = m.groupBy("clique").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("size"))
    return (
        m.select("clique", F.col("node").alias("u"))
        .join(low.where("size > 1"), "clique")
        .where("u <> v")
        .select("u", "v")
        .distinct()
    )


def member_components(m: DataFrame) -> DataFrame:
    """(node, component) for nodes that share a group with somebody."""
    return components(group_stars(m))
