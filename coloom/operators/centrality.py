"""Position of a node in the co-location graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators.colocation import shared, symmetric
from coloom.operators.neighbors import NARROW, few_groups, meetings, neighbor_sums, signatures, subsets
from coloom.operators.paths import PAIRS, component_dependencies, small_components
from coloom.session import cut

DAMPING = 0.85


def with_nodes(nodes: DataFrame, measures: DataFrame) -> DataFrame:
    """All nodes, with 0 for a measure they lack."""
    names = [c for c in measures.columns if c != "node"]
    return nodes.select("node").join(measures, "node", "left").na.fill(0, names)


def local_rank(m: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, degree, local_rank): a rank score that uses only a node's own value.

    ``rounds`` steps of r <- 1/N + 0.85 r s with s = sum of 1/degree over the
    neighbours.  Every step reads the node's own r, so the result is a polynomial
    in s and needs one pass over the graph.
    """
    s = m if "n" in m.columns else cut(shared(m))
    deg = neighbor_sums(s)
    inverse = deg.select("node", (1 / F.col("degree")).alias("inv"))
    reach = neighbor_sums(s, inverse, ["inv"])
    every = with_nodes(nodes, reach)
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = F.lit(1.0)
    for _ in range(rounds):
        rank = F.lit(1.0) + F.lit(DAMPING) * F.col("sum_inv") * rank
    return every.select("node", F.col("degree").cast("long").alias("degree"), (rank / n).alias("local_rank"))


def global_rank(m: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, global_rank): ``rounds`` steps of r <- 0.85 (A r) / degree + 0.15 / N."""
    s = m if "n" in m.columns else cut(shared(m))
    total = nodes.count()
    base = 0.15 / total
    ranks = nodes.select("node", F.lit(1.0 / total).alias("r"))
    for i in range(rounds):
        pulled = neighbor_sums(s, ranks, ["r"]).select(
            "node", (DAMPING * F.col("sum_r") / (F.col("degree") + F.lit(1e-9))).alias("pull")
        )
        ranks = with_nodes(nodes, pulled).select("node", (F.col("pull") + base).alias("r"))
        if i < rounds - 1:
            ranks = cut(ranks)
    return ranks.withColumnRenamed("r", "global_rank")


def two_hop_walks(m: DataFrame) -> DataFrame:
    """(node, degree, walks): number of two-step walks, the sum of neighbour degrees."""
    s = m if "n" in m.columns else cut(shared(m))
    deg = neighbor_sums(s)
    out = neighbor_sums(s, deg.withColumn("d", F.col("degree").cast("double")), ["d"])
    return out.select("node", "degree", F.col("sum_d").cast("long").alias("walks"))


def transitivity_share(m: DataFrame) -> DataFrame:
    """(node, degree, closed, share): neighbours that touch another neighbour.

    Two members of a group of three or more are closed by that group.  So only
    pairs that share nothing but groups of two can be open, and there are no more
    of them than groups of two.  Each is tried with the neighbours of its end of
    lower degree: it is closed if one of them shares a group with the other end.
    """
    s = m if "n" in m.columns else cut(shared(m))
    deg = cut(neighbor_sums(s).select("node", "degree"))
    twos = s.where("n = 2").groupBy("clique").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    big = s.where("n > 2").select("node", "clique")
    inside = (
        twos.join(big.withColumnRenamed("node", "a"), "a").join(big.withColumnRenamed("node", "b"), ["b", "clique"]).select("a", "b").distinct()
    )
    bare = (
        twos.join(inside, ["a", "b"], "left_anti")
        .join(deg.withColumnsRenamed({"node": "a", "degree": "da"}), "a")
        .join(deg.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    )
    low = F.col("da") <= F.col("db")
    bare = cut(bare.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    groups = s.select("node", "clique")
    thirds = (
        bare.join(groups.withColumnRenamed("node", "x"), "x")
        .join(groups.withColumnRenamed("node", "z"), "clique")
        .where("z <> x and z <> y")
        .select("x", "y", "z")
        .distinct()
    )
    closed = (
        thirds.join(groups.withColumnRenamed("node", "z"), "z")
        .join(groups.withColumnRenamed("node", "y"), ["y", "clique"], "left_semi")
        .select("x", "y")
        .distinct()
    )
    opened = symmetric(bare.join(closed, ["x", "y"], "left_anti").select(F.col("x").alias("src"), F.col("y").alias("dst")))
    counts = opened.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    closed_n = F.col("degree") - F.coalesce("open", F.lit(0))
    return deg.join(counts, "node", "left").select(
        "node", "degree", closed_n.alias("closed"), (closed_n / F.col("degree")).alias("share")
    )


def betweenness(
    m: DataFrame, n_nodes: int, as_coded: bool = False, block: int = 4096, narrow: int = NARROW, most: int = PAIRS
) -> DataFrame:
    """(node, betweenness): shortest-path betweenness from every source.

    ``m`` holds memberships (node, clique); an edge table (src, dst) is taken as groups of
    two.  No pair of a group is formed:

    * Nodes in the same groups are twins.  They are on no path of one another, and all of them
      lie on as many others; a class of twins is one node with a weight.
    * Paths go from class to hub to class.  A hub is a set of groups that two classes or more are
      in together.  Classes may share several groups, and that is one edge; so sums over
      hubs are signed by inclusion and exclusion.  A class of more than ``narrow`` groups has a
      hub of its own with each class it meets.
    * A hub is on the way of a source once, in the wave that reaches it first.

    Breadth-first waves and their back-propagation run as joins over (source, class) and
    (source, hub) rows, so they spread over the cluster and no task holds the graph.  Sources
    are taken in blocks of about ``block`` classes, so the rows held at a time are those of one
    block; every source has its turn.  Each wave is written out.  The usual scale counts an
    unordered pair once; ``as_coded=True`` counts it twice.
    """
    if "clique" not in m.columns:
        edge = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        m = m.select(F.explode(F.array("src", "dst")).alias("node"), edge.alias("clique")).distinct()
    s = m if "n" in m.columns else cut(shared(m))
    own, classes, of_sig = _classes(s)
    total = classes.select("v", F.lit(0.0).alias("dep"))
    groups = cut(of_sig.join(classes, "sig").select(F.col("v").alias("node"), F.col("g").alias("clique")))
    parts = small_components(groups, most)
    if not parts.where("small").isEmpty():
        inside = groups.join(parts.where("small").select("node"), "node", "left_semi")
        weights = classes.select(F.col("v").alias("node"), "weight")
        walked = component_dependencies(inside, parts.where("small").select("node", "component"), weights)
        total = total.unionByName(walked.withColumnRenamed("node", "v"))
    wide = parts.where("not small").select(F.col("node").alias("v"))
    if not wide.isEmpty():
        total = total.unionByName(_walk_hubs(classes.join(wide, "v", "left_semi"), of_sig, narrow, block))
    pairs = (n_nodes - 1) * (n_nodes - 2)
    scale = (2.0 if as_coded else 1.0) / pairs if pairs > 0 else 1.0
    by_class = total.groupBy("v").agg((F.sum("dep") * scale).alias("betweenness"))
    return own.join(classes.select("sig", "v"), "sig").join(by_class, "v").select("node", "betweenness")


def _walk_hubs(classes: DataFrame, of_sig: DataFrame, narrow: int, block: int) -> DataFrame:
    """(v, dep) of ``classes(sig, v, weight)``, whole components, by rows of sources and what they reach."""
    classes = cut(classes)
    arcs = _hubs(classes, of_sig.join(classes.select("sig"), "sig", "left_semi"), narrow)
    start = classes.select("v", "weight")
    blocks = max(1, -(-start.count() // block))
    total = start.select("v", F.lit(0.0).alias("dep"))
    for i in range(blocks):
        some = start if blocks == 1 else start.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == i)
        part = _dependencies(classes.select("v", "weight"), arcs, some)
        if part is not None:
            total = total.unionByName(part)
            if blocks > 1:  # one small table of classes instead of all waves so far
                total = cut(total.groupBy("v").agg(F.sum("dep").alias("dep")))
    return total


def _classes(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (node, sig), the classes of twins (sig, v, weight), and the groups of these (sig, g)."""
    groups = s.select("node", F.to_json(F.struct("clique")).alias("g"))
    own = cut(signatures(groups))
    ids = cut(own.groupBy("sig").agg(F.min("node").alias("v"), F.count(F.lit(1)).cast("double").alias("weight")))
    of_sig = groups.join(ids.select(F.col("v").alias("node"), "sig"), "node").select("sig", "g")
    return own, ids, cut(of_sig)


def _hubs(ids: DataFrame, of_sig: DataFrame, narrow: int) -> DataFrame:
    """The arcs (v, hub, sign) from classes (sig, v) to what they meet at."""
    of_sig = cut(of_sig)
    subs = subsets(few_groups(of_sig, narrow)).select("sig", F.xxhash64("sub").alias("hub"), F.xxhash64(F.lit(1), "sub").alias("hub2"), F.when(F.size("sub") % 2 == 1, 1).otherwise(-1).alias("sign"))
    # A wide class and each other class that it meets, once.
    met = meetings(of_sig, narrow).where((F.col("o.h") <= narrow) | (F.to_json("w") < F.to_json("o")))
    both = met.select(F.explode(F.array("w", "o")).alias("sig"), F.xxhash64("w", "o").alias("hub"), F.xxhash64(F.lit(1), "w", "o").alias("hub2"), F.lit(1).alias("sign"))
    every = subs.unionByName(both).join(ids.select("sig", "v"), "sig").select("v", F.struct("hub", "hub2").alias("hub"), "sign")
    every = cut(every)
    used = every.groupBy("hub").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("hub")
    return cut(every.join(used, "hub"))


def _dependencies(classes: DataFrame, arcs: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(v, dep): how much a node of each class lies on the shortest paths from the nodes of ``sources``; None without a path.

    Paths and shares are those of one node of the source's class and count for all of them.
    """
    one = F.lit(1.0)
    waves = [cut(sources.select(F.col("v").alias("s"), F.col("weight").alias("times"), "v", one.alias("weight"), one.alias("paths")))]
    reached = []
    while True:
        hubs = waves[-1].join(arcs, "v").groupBy("s", "times", "hub").agg(F.sum(F.col("weight") * F.col("paths")).alias("paths"))
        if reached:  # a hub of this wave's classes was reached by it, or by the wave before
            hubs = hubs.join(reached[-1].select("s", "hub"), ["s", "hub"], "left_anti")
        hubs = cut(hubs)
        step = (
            hubs.join(arcs, "hub")
            .groupBy("s", "times", "v")
            .agg(F.sum(F.col("sign") * F.col("paths")).alias("paths"))
            .join(waves[-1].select("s", "v"), ["s", "v"], "left_anti")
            .join(classes, "v")
            .select("s", "times", "v", "weight", "paths")
        )
        step = cut(step)
        if step.isEmpty():
            break
        reached.append(hubs)
        waves.append(step)
    total = None
    credit = waves[-1].withColumn("dep", F.lit(0.0))
    for i in range(len(waves) - 1, 0, -1):
        part = credit.select("v", (F.col("times") * F.col("dep")).alias("dep"))
        total = part if total is None else total.unionByName(part)
        if i == 1:
            break
        give = (
            credit.select("s", "v", (F.col("weight") * (1 + F.col("dep")) / F.col("paths")).alias("share"))
            .join(arcs, "v")
            .groupBy("s", "hub")
            .agg(F.sum("share").alias("share"))
            .join(reached[i - 1].select("s", "hub"), ["s", "hub"], "left_semi")
            .join(arcs, "hub")
            .groupBy("s", "v")
            .agg(F.sum(F.col("sign") * F.col("share")).alias("share"))
        )
        credit = cut(
            waves[i - 1]
            .join(give, ["s", "v"], "left")
            .select("s", "times", "v", "weight", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dep"))
        )
    return total
