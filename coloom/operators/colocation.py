"""Who was at the same place at (nearly) the same time.

The co-location graph is a union of cliques: everyone at one (province, venue)
within a window of ``k`` days is linked to everyone else there.  It is kept in
that form, as ``members(node, clique)``, which grows with the visits; a group
stands for an edge between any two of its members, whatever its size.  ``pairs``
writes the edges out, for measures that weigh every single one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Members of a group that one task pairs with the whole group.
BLOCK = 1000


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def day_of(number: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), number)


# -- labels -------------------------------------------------------------------


def cluster_labels(
    visits: DataFrame, ks: Sequence[int] = (3,), by: Sequence[str] = ("province", "venue")
) -> DataFrame:
    """(case_id, label_<k>...): 1 when another case was at the same place within k days.

    No self-join.  Visits are first reduced to the smallest and largest case per
    place and day; a range window over those rows gives the smallest and largest
    case within k days, and they differ exactly when somebody else was there.  One
    window per k, all in one pass.
    """
    by = list(by)
    d = dated(visits, by)
    names = [f"label_{k}" for k in ks]
    # A label only grows with k, so places and days without company at the widest
    # window are dropped before the join.
    cells = _company(d, ks, by).where(F.col(f"label_{max(ks)}") == 1)
    return (
        d.join(cells, [*by, "d"])
        .groupBy("case_id")
        .agg(*[F.max(n).alias(n) for n in names])
    )


def dated(visits: DataFrame, by: Sequence[str], *extra: Column) -> DataFrame:
    """(case_id, *by, d) with a day number; rows with a missing key are dropped."""
    d = visits.select("case_id", *by, day_number(F.col("day")).alias("d"), *extra)
    return d.where(" and ".join(f"{c} is not null" for c in ["case_id", *by, "d"]))


def _company(d: DataFrame, ks: Sequence[int], by: Sequence[str]) -> DataFrame:
    """(*by, d, label_<k>...): whether two different cases were there within k days."""
    cells = d.groupBy(*by, "d").agg(F.min("case_id").alias("lo"), F.max("case_id").alias("hi"))
    for k in ks:
        lo, hi = F.col("lo"), F.col("hi")
        if k > 0:
            near = Window.partitionBy(*by).orderBy("d").rangeBetween(-k, k)
            lo, hi = F.min(lo).over(near), F.max(hi).over(near)
        cells = cells.withColumn(f"label_{k}", (lo != hi).cast("int"))
    return cells.drop("lo", "hi")


def label_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """All cases with their labels, 0 for cases without a dated visit."""
    names = [c for c in labels.columns if c != "case_id"]
    return cases.select("case_id").join(labels, "case_id", "left").na.fill(0, names)


def crowd_labels(degrees: DataFrame, min_others: int) -> DataFrame:
    """(case_id, label): 1 with at least ``min_others`` distinct neighbours.

    ``degrees(node, degree)`` comes from ``neighbor_sums``.  ``cluster_labels`` is the
    cheaper way for ``min_others=1``.
    """
    return degrees.select(
        F.col("node").alias("case_id"), (F.col("degree") >= min_others).cast("int").alias("label")
    )


# -- clique form --------------------------------------------------------------


def members(
    visits: DataFrame,
    k: int = 0,
    by: Sequence[str] = ("province", "venue"),
    node: Column | None = None,
) -> DataFrame:
    """(node, clique): distinct subjects of every window of k days at a place.

    Two visits are within k days of each other exactly when some window
    [start, start + k] holds both, so each visit joins k + 1 windows.  A window
    nobody entered on its first day is contained in the next one and is dropped,
    and so is a visit nobody came near.  ``node`` defaults to the case; pass a struct to keep graphs of several slices
    apart.  ``k=0`` is the same-day graph.
    """
    node = F.col("case_id") if node is None else node
    by = list(by)
    d = dated(visits, by, node.alias("node"))
    if k == 0:
        return d.select("node", F.struct(*by, "d").alias("clique")).distinct()
    met = _company(d, [k], by).where(f"label_{k} = 1").select(*by, "d")
    rows = (
        d.join(met, [*by, "d"], "left_semi")
        .select("node", *by, "d", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("gap"))
        .select("node", F.struct(*by, (F.col("d") - F.col("gap")).alias("d")).alias("clique"), "gap")
        .groupBy("node", "clique")
        .agg(F.min("gap").alias("gap"))
    )
    used = rows.where("gap = 0").select("clique").distinct()
    return rows.select("node", "clique").join(used, "clique", "left_semi")


def shared(m: DataFrame) -> DataFrame:
    """Members of groups of two or more, with the group size ``n``.

    Cut the result (``session.cut``) when several measures of one graph follow.
    """
    if "n" in m.columns:
        return m
    sizes = m.groupBy("clique").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return m.join(sizes, "clique")


def pairs(m: DataFrame, multigraph: bool = False) -> DataFrame:
    """All edges src < dst of the graph; ``multigraph=True`` keeps one per shared group.

    The number of rows is quadratic in the group sizes.  A large group is dealt to
    many tasks: each takes a block of its members and pairs it with all of them.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    s = shared(m).select("clique", "node", blocks.alias("blocks"))
    left = s.select("clique", F.col("node").alias("src"), F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).alias("block"))
    right = s.select(
        "clique", F.col("node").alias("dst"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")
    )
    both = left.join(right, ["clique", "block"]).where("src < dst").select("src", "dst")
    return both if multigraph else both.distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of an undirected edge table."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    )


def edges(m: DataFrame) -> DataFrame:
    """The whole graph in one form for every group size: (node, clique, n).

    A group of n members stands for the n (n - 1) / 2 edges between them.
    """
    return shared(m).select("node", "clique", "n")


def band_edges(visits: DataFrame, k: int = 3, by: Sequence[str] = ("province", "venue")) -> DataFrame:
    """The ±k day graph with its days: (node, clique, day, n).

    Two members of a group are linked at the distance of their days; the smallest
    one over their shared groups counts.  ``pair_gaps`` writes it out.
    """
    by = list(by)
    d = dated(visits, by)
    met = _company(d, [k], by).where(f"label_{k} = 1").select(*by, "d")
    rows = d.join(met, [*by, "d"], "left_semi").distinct()
    spread = rows.select(
        "case_id", *by, "d", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("gap")
    ).select(
        F.col("case_id").alias("node"),
        F.struct(*by, (F.col("d") - F.col("gap")).alias("d")).alias("clique"),
        F.col("d").alias("day"),
    )
    who = spread.groupBy("clique", "node").agg(F.min("day").alias("first"))
    sizes = (
        who.groupBy("clique")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
        .where((F.col("n") > 1) & (F.col("first") == F.col("clique.d")))
        .drop("first")
    )
    return spread.join(sizes, "clique").select("node", "clique", "day", "n")


def place_crowds(d: DataFrame, k: int, by: Sequence[str], crowd: int) -> DataFrame:
    """(case_id, *by, d, crowded) of the ``dated`` visits that somebody else came near; a place is
    crowded where some window of k days has ``crowd`` visits."""
    by = list(by)
    cells = d.groupBy(*by, "d").agg(F.min("case_id").alias("lo"), F.max("case_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(*by)
    near = place.orderBy("d").rangeBetween(-k, k)
    cells = cells.withColumns(
        {"lo": F.min("lo").over(near), "hi": F.max("hi").over(near), "n": F.sum("n").over(place.orderBy("d").rangeBetween(-k, 0))}
    ).withColumn("crowded", F.max("n").over(place) >= crowd)
    return d.join(cells.where("lo <> hi").select(*by, "d", "crowded"), [*by, "d"]).distinct()


def close_pairs(near: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """(src, dst, gap): the pairs src < dst of cases at a place within k days, and the fewest days between them.

    Days are dealt to bins of k + 1; a later visit is in the bin of an earlier one or in the next.
    """
    by = list(by)
    bin_of = F.floor(F.col("d") / F.lit(k + 1)).cast("int")
    early = near.select(*by, F.col("case_id").alias("a"), F.col("d").alias("from"), F.explode(F.array(bin_of, bin_of + 1)).alias("bin"))
    late = near.select(*by, F.col("case_id").alias("b"), F.col("d").alias("to"), bin_of.alias("bin"))
    gap = F.col("to") - F.col("from")
    met = early.join(late, [*by, "bin"]).where((F.col("a") != F.col("b")) & gap.between(0, k))
    return met.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min(gap).alias("gap"))


def pair_gaps(band: DataFrame, tau: float = 7.0) -> DataFrame:
    """(src, dst, min_gap, weight) of every edge of ``band_edges``, weight exp(-min_gap / tau)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = band.select("clique", F.col("node").alias("src"), F.col("day").alias("d"), F.pmod(F.xxhash64("node"), blocks.cast("long")).alias("block"))
    right = band.select(
        "clique", F.col("node").alias("dst"), F.col("day").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block")
    )
    return (
        left.join(right, ["clique", "block"])
        .where("src < dst")
        .groupBy("src", "dst")
        .agg(F.min(F.abs(F.col("d") - F.col("e"))).alias("min_gap"))
        .withColumn("weight", F.exp(-F.col("min_gap") / F.lit(float(tau))))
    )
