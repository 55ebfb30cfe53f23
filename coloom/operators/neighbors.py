"""Sums over distinct neighbours without listing the neighbours.

``members(node, clique)`` says who belongs to which group; the neighbours of a
node are everyone who shares at least one group with it, each counted once.

Groups below ``fanout`` are expanded to pairs, which costs at most ``fanout`` rows
per membership.  A larger group is never expanded.  Nodes in the same set of large
groups have the same neighbours there, so they are collapsed to one signature, and
the union of a signature's groups is summed cell by cell (``unions``): a row for each
membership of a signature, and no row for two signatures that meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from coloom.operators.colocation import close_pairs, dated, day_of, members, pairs, place_crowds, shared, symmetric
from coloom.operators.unions import BLOCK, union_sums
from coloom.session import cut

# Groups of this many subjects or more are not expanded.
FANOUT = 50
# At most 2**NARROW - 1 subsets are formed per set of groups where these are written out (``subsets``).
NARROW = 8
# A task holds totals of at most 2**BITS sets of groups.
BITS = 20


@dataclass
class SmallGroups:
    """A graph whose groups are all below ``FANOUT``, as arcs that repeated sums share."""

    arcs: DataFrame


def repeated(s: DataFrame) -> DataFrame | SmallGroups:
    """``s(node, clique, n)`` in the form that is cheaper to sum over many times.

    Arcs are written once where no group is large; else the groups stay as they are.
    """
    if not s.where(F.col("n") >= FANOUT).isEmpty():
        return s
    return SmallGroups(cut(symmetric(pairs(s))))


def neighbor_sums(
    m: DataFrame | SmallGroups,
    values: DataFrame | None = None,
    cols: Sequence[str] = (),
    fanout: int = FANOUT,
    narrow: int = BITS,
    more: DataFrame | None = None,
) -> DataFrame:
    """(node, degree, sum_<col>...) for every node with a neighbour.

    ``values(node, *cols)`` holds what is summed over the neighbours; a node
    missing there adds 0.  ``more(src, dst)`` are arcs besides those of the groups.
    """
    cols = list(cols)
    if isinstance(m, SmallGroups):
        return _sum_pairs(m.arcs, values, cols).groupBy("node").agg(*_totals(cols))
    s = m if "n" in m.columns else cut(shared(m))
    near = symmetric(pairs(s.where(F.col("n") < fanout)))
    if more is not None:
        near = near.unionByName(more).distinct()
    large = numbered(s.where(F.col("n") >= fanout))
    if large.isEmpty():  # the steps below would be run on nothing
        return _sum_pairs(near, values, cols).groupBy("node").agg(*_totals(cols))
    sums = ["one", *cols]

    own = signatures(large)
    if cols:
        own = own.join(values.select("node", *cols), "node", "left").na.fill(0, cols)
    own = own.withColumn("one", F.lit(1).cast("long"))
    sigs = cut(own.groupBy("sig").agg(F.min("node").alias("node"), *[F.sum(c).alias(c) for c in sums]))
    sets = sets_of(large, sigs)
    points = sigs.select("sig", F.lit(0.0).alias("x"), *[F.col(c).alias(f"all_{c}") for c in sums])
    names = [f"all_{c}" for c in sums]
    reach = union_sums(sets, points.select("sig", F.col("x").alias("at")), points, names, [], narrow)
    reach = reach.select("sig", *[_like(c, points) for c in names])
    from_large = own.join(reach, "sig").select("node", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in sums])

    parts = _sum_pairs(uncovered(near, own, sets), values, cols).unionByName(from_large)
    return parts.groupBy("node").agg(*_totals(cols)).where("degree > 0")


def _like(name: str, df: DataFrame):
    """A total in double precision as what it is in ``df``."""
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, DoubleType) else F.round(name).cast(kind).alias(name)


def numbered(groups: DataFrame) -> DataFrame:
    """(node, g): the memberships with a number for each group."""
    ids = cut(groups.select("clique").distinct().withColumn("g", F.monotonically_increasing_id()))
    return groups.join(ids, "clique").select("node", "g")


def sets_of(large: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sig, groups): the sorted numbers of the groups of each signature, as one of its nodes has them."""
    of_sig = large.join(sigs.select("node", "sig"), "node")
    return cut(of_sig.groupBy("sig").agg(F.array_sort(F.collect_list("g")).alias("groups")))


def signatures(groups: DataFrame) -> DataFrame:
    """(node, sig) of ``groups(node, g)``; nodes in the same set of groups share a signature.

    Two 64-bit sums over the groups and their number stand for the set.
    """
    return groups.groupBy("node").agg(
        F.struct(
            F.count(F.lit(1)).alias("h"), F.bit_xor(F.xxhash64("g")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "g")).alias("b")
        ).alias("sig")
    )


def few_groups(of_sig: DataFrame, narrow: int = NARROW) -> DataFrame:
    """(sig, groups) of the signatures of at most ``narrow`` groups."""
    return of_sig.where(F.col("sig.h") <= narrow).groupBy("sig").agg(F.array_sort(F.collect_list("g")).alias("groups"))


def subsets(few: DataFrame) -> DataFrame:
    """(sig, sub): each set of groups, except none, of each signature."""
    every = F.expr(
        "transform(sequence(1, shiftleft(1, size(groups)) - 1),"
        " b -> filter(groups, (g, i) -> (shiftright(b, i) & 1) = 1))"
    )
    return few.select("sig", F.explode(every).alias("sub"))


def meetings(of_sig: DataFrame, narrow: int = NARROW) -> DataFrame:
    """(w, o): signatures of many groups meet the signatures they share a group with, themselves too."""
    wide = of_sig.where(F.col("sig.h") > narrow).select(F.col("sig").alias("w"), "g")
    return wide.join(of_sig.select(F.col("sig").alias("o"), "g"), "g").select("w", "o").distinct()


def uncovered(near: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) from small groups that no large group already covers."""
    groups = own.select("node", "sig").join(sets, "sig").select("node", "groups")
    return (
        near.join(groups.withColumnsRenamed({"node": "src", "groups": "s_groups"}), "src", "left")
        .join(groups.withColumnsRenamed({"node": "dst", "groups": "d_groups"}), "dst", "left")
        .where(~F.coalesce(F.arrays_overlap("s_groups", "d_groups"), F.lit(False)))
        .select("src", "dst")
    )


def _totals(cols: Sequence[str]):
    return [F.sum("one").alias("degree"), *[F.sum(c).alias(f"sum_{c}") for c in cols]]


def _sum_pairs(pairs: DataFrame, values: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """(node, one, *cols): totals over the listed partners of each node."""
    if cols:
        pairs = pairs.join(
            values.select(F.col("node").alias("dst"), *cols), "dst", "left"
        ).na.fill(0, list(cols))
    return pairs.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("one"), *[F.sum(c).alias(c) for c in cols]
    )


def threshold_sums(
    m: DataFrame | SmallGroups,
    rows: DataFrame,
    low: Sequence[str],
    high: Sequence[str],
    fanout: int = FANOUT,
    narrow: int = BITS,
    block: int = BLOCK,
) -> DataFrame:
    """(node, <low>.., <high>..): sums over the distinct neighbours on either side of a node's own threshold.

    ``rows(node, x, at, *low, *high)`` has every node of ``m`` once.  For node i the
    columns ``low`` are summed over the neighbours j with x_j <= at_i, ``high`` over those
    with x_j > at_i.

    Unions of groups are summed in cells as in ``neighbor_sums``, with the points of a cell in
    the order of x and the totals read at the thresholds.  A task takes at most about ``block`` of
    the thresholds and of the points of a cell.
    """
    cols = [*low, *high]
    side = {c: F.col("x") <= F.col("at") for c in low} | {c: F.col("x") > F.col("at") for c in high}

    def of_pairs(arcs: DataFrame) -> DataFrame:
        both = arcs.join(rows.select(F.col("node").alias("src"), "at"), "src").join(rows.select(F.col("node").alias("dst"), "x", *cols), "dst")
        return both.groupBy(F.col("src").alias("node")).agg(*[F.sum(F.when(side[c], F.col(c)).otherwise(0.0)).alias(c) for c in cols])

    if isinstance(m, SmallGroups):
        return of_pairs(m.arcs)
    s = m if "n" in m.columns else cut(shared(m))
    near = symmetric(pairs(s.where(F.col("n") < fanout)))
    large = numbered(s.where(F.col("n") >= fanout))
    if large.isEmpty():
        return of_pairs(near)
    own = cut(signatures(large))
    sets = sets_of(large, own.groupBy("sig").agg(F.min("node").alias("node")))
    who = cut(own.join(rows, "node"))
    points = who.groupBy("sig", "x").agg(*[F.sum(c).alias(c) for c in cols])
    told = union_sums(sets, who.select("sig", "at").distinct(), points, low, high, narrow, block)
    told = told.select("sig", "at", *[F.col(c).alias(f"t_{c}") for c in cols])
    # A node does not count itself.
    mine = {c: F.when(side[c], F.col(c)).otherwise(0.0) for c in cols}
    from_large = who.join(told, ["sig", "at"]).select("node", *[(F.col(f"t_{c}") - mine[c]).alias(c) for c in cols])
    parts = of_pairs(uncovered(near, own, sets)).unionByName(from_large)
    return parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in cols])


def degrees(m: DataFrame, **kw) -> DataFrame:
    """(node, degree) for nodes with at least one neighbour."""
    return neighbor_sums(m, **kw)


@dataclass
class Band:
    """The ±k day graph: ``arcs(src, dst, gap)``, both ways, from the places without a large group, and the visits to the others."""

    arcs: DataFrame
    crowds: DataFrame | None


def band(visits: DataFrame, k: int, by: Sequence[str] = ("province", "venue"), fanout: int = FANOUT) -> Band:
    """The graphs of all windows up to ``k`` days from one pass over the visits.

    Where no window of a place has ``fanout`` visits, a visit has fewer than 2 ``fanout`` others
    near it, and its pairs are written once, with their smallest distance in days.  Visits to other
    places keep the form of groups.  A pair may be in both.
    """
    near = cut(place_crowds(dated(visits, by), k, by, fanout))
    arcs = cut(symmetric(close_pairs(near.where("not crowded"), k, by)))
    crowds = near.where("crowded").select("case_id", *by, day_of(F.col("d")).alias("day"))
    return Band(arcs, None if crowds.isEmpty() else crowds)


def layered_members(
    visits: DataFrame, k: int, by: Sequence[str] = ("province", "venue")
) -> DataFrame:
    """The graphs of windows 0..k side by side: nodes are (layer, case)."""
    layers = None
    for j in range(k + 1):
        node = F.struct(F.lit(j).alias("layer"), F.col("case_id").alias("id"))
        layer = members(visits, j, by, node).withColumn(
            "clique", F.struct(F.lit(j).alias("layer"), F.col("clique").alias("at"))
        )
        layers = layer if layers is None else layers.unionByName(layer)
    return layers


def _layered(b: Band, k: int) -> DataFrame:
    """The arcs of a band in the graphs of windows 0..k that have them; nodes are (layer, case)."""
    each = b.arcs.withColumn("layer", F.explode(F.sequence(F.col("gap"), F.lit(k))))
    return each.select(*[F.struct("layer", F.col(c).alias("id")).alias(c) for c in ("src", "dst")])


def decayed_weights(visits: DataFrame, taus: Sequence[float], k: int = 3, by: Sequence[str] = ("province", "venue"), fanout: int = FANOUT) -> DataFrame:
    """(node, tau, weight): the summed weight exp(-min gap / tau) of each node's edges, every tau from one pass."""
    b = band(visits, k, by, fanout)
    taus = F.explode(F.lit([float(t) for t in taus]))
    if b.crowds is None:
        each = b.arcs.groupBy(F.col("src").alias("node"), "gap").count().withColumn("tau", taus)
        return each.groupBy("node", "tau").agg(F.sum(F.col("count") * F.exp(-F.col("gap") / F.col("tau"))).alias("weight"))
    layer = F.col("node.layer")
    each = neighbor_sums(layered_members(b.crowds, k, by), fanout=fanout, more=_layered(b, k)).withColumn("tau", taus)
    here = F.exp(-layer / F.col("tau"))
    after = F.when(layer == k, 0.0).otherwise(F.exp(-(layer + 1) / F.col("tau")))
    return each.groupBy(F.col("node.id").alias("node"), "tau").agg(F.sum((here - after) * F.col("degree")).alias("weight"))


def decayed_sums(
    visits: DataFrame,
    values: DataFrame,
    cols: Sequence[str],
    k: int = 3,
    tau: float = 7.0,
    by: Sequence[str] = ("province", "venue"),
    fanout: int = FANOUT,
    **kw,
) -> DataFrame:
    """(node, weight, sum_<col>...): neighbour sums weighted by exp(-min gap / tau).

    Without large groups, an arc is its partner's values times its weight.  Else the graphs of
    windows 0..k are nested, so the weighted sum is a combination of k + 1 plain sums with
    coefficients w(j) - w(j + 1).
    """
    cols = list(cols)
    b = band(visits, k, by, fanout)
    if b.crowds is None:
        arcs = b.arcs.select("src", "dst", F.exp(-F.col("gap") / F.lit(float(tau))).alias("w"))
        if cols:
            arcs = arcs.join(values.select(F.col("node").alias("dst"), *cols), "dst", "left").na.fill(0, cols)
        return arcs.groupBy(F.col("src").alias("node")).agg(
            F.sum("w").alias("weight"), *[F.sum(F.col("w") * F.col(c)).alias(f"sum_{c}") for c in cols]
        )
    layers = layered_members(b.crowds, k, by)
    spread = values.select(
        F.explode(F.sequence(F.lit(0), F.lit(k))).alias("layer"), F.col("node").alias("id"), *cols
    ).select(F.struct("layer", "id").alias("node"), *cols)
    sums = neighbor_sums(layers, spread, cols, fanout, more=_layered(b, k), **kw)
    layer = F.col("node.layer")
    here = F.exp(-layer / F.lit(float(tau)))
    after = F.when(layer == k, 0.0).otherwise(F.exp(-(layer + 1) / F.lit(float(tau))))
    return sums.groupBy(F.col("node.id").alias("node")).agg(
        F.sum((here - after) * F.col("degree")).alias("weight"),
        *[F.sum((here - after) * F.col(f"sum_{c}")).alias(f"sum_{c}") for c in cols],
    )
