"""Neighbour features and graph embeddings over an edge table.

Joins, softmax weights and weighted sums are Spark aggregates with map-side
combine.  numpy only multiplies an Arrow batch of feature rows by a fixed matrix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coloom.operators.centrality import global_rank, two_hop_walks
from coloom.operators.colocation import members, shared
from coloom.operators.neighbors import FANOUT, decayed_sums, neighbor_sums, threshold_sums
from coloom.session import cut


# -- pair-free neighbour aggregates -------------------------------------------


def neighbor_means(m: DataFrame, values: DataFrame, cols: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """(node, degree, mean_<col>...): plain mean over the distinct neighbours."""
    sums = neighbor_sums(m, values, cols, fanout=fanout)
    return sums.select("node", "degree", *[(F.col(f"sum_{c}") / F.col("degree")).alias(f"mean_{c}") for c in cols])


def neighbor_maxima(m: DataFrame, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(node, max_<col>...): largest neighbour value, straight from the groups.

    A group's best member serves everyone but itself; it gets the runner-up.
    """
    s = m if "n" in m.columns else cut(shared(m))
    rows = s.select("node", "clique").join(values.select("node", *cols), "node")
    best = rows.groupBy("clique").agg(*[F.max(F.struct(c, "node")).alias(f"b_{c}") for c in cols])
    both = rows.select("clique", "node", *cols).join(best, "clique")
    second = both.groupBy("clique").agg(
        *[F.max(F.when(F.col("node") != F.col(f"b_{c}.node"), F.col(c))).alias(f"r_{c}") for c in cols]
    )
    return (
        both.join(second, "clique")
        .groupBy("node")
        .agg(
            *[
                F.max(
                    F.when(F.col("node") == F.col(f"b_{c}.node"), F.col(f"r_{c}")).otherwise(F.col(f"b_{c}.{c}"))
                ).alias(f"max_{c}")
                for c in cols
            ]
        )
    )


def temporal_proximity(m: DataFrame, days: DataFrame, tau: float = 7.0) -> DataFrame:
    """(node, proximity): exp(-gap / tau) to the neighbour with the nearest day.

    ``days(node, day)`` gives one day number per node.  A minimum does not mind
    that groups overlap, so it is taken group by group over (group, day) cells:
    the nearest other node of a cell's day is in it, or in the cell before or after.
    """
    s = m if "n" in m.columns else cut(shared(m))
    rows = s.select("node", "clique").join(days.select("node", "day"), "node").where("day is not null")
    cells = rows.groupBy("clique", "day").agg(F.count(F.lit(1)).alias("here"))
    along = Window.partitionBy("clique").orderBy("day")
    before, after = F.col("day") - F.lag("day").over(along), F.lead("day").over(along) - F.col("day")
    gaps = cells.withColumn("gap", F.when(F.col("here") > 1, 0).otherwise(F.least(before, after)))
    return (
        rows.join(gaps.where("gap is not null").select("clique", "day", "gap"), ["clique", "day"])
        .groupBy("node")
        .agg(F.exp(-F.min("gap") / F.lit(float(tau))).alias("proximity"))
    )


def gcn_propagate(m: DataFrame, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One pass of D^-1/2 (A + I) D^-1/2 over the columns; degrees count the loop."""
    cols = list(cols)
    s = m if "n" in m.columns else cut(shared(m))
    root = F.sqrt(1 / (F.coalesce("degree", F.lit(0)) + 1.0))
    scaled = cut(
        values.select("node", *cols)
        .join(neighbor_sums(s).select("node", "degree"), "node", "left")
        .select("node", root.alias("root"), *[(root * F.col(c)).alias(c) for c in cols])
    )
    pulled = neighbor_sums(s, scaled.select("node", *cols), cols).drop("degree")
    return scaled.join(pulled, "node", "left").select(
        "node", *[(F.col("root") * (F.coalesce(F.col(f"sum_{c}"), F.lit(0.0)) + F.col(c))).alias(c) for c in cols]
    )


# -- feature sets for the graph-aware classifiers -----------------------------


def structure_features(m: DataFrame, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Five structural features per node of ``values``.

    Degree and two-step walks relative to their maxima, mean and population std of
    the neighbour means across the columns, and the global rank.
    """
    s = m if "n" in m.columns else cut(shared(m))
    means = neighbor_means(s, values, cols)
    walks = two_hop_walks(s).select("node", "walks")
    rank = global_rank(s, values.select("node"))
    rows = cut(
        values.select("node").join(means, "node", "left").join(walks, "node", "left").join(rank, "node").na.fill(0)
    )
    top = rows.agg(F.max("degree").alias("d"), F.max("walks").alias("w"))
    means_of = [F.col(f"mean_{c}") for c in cols]
    mean = sum(means_of[1:], means_of[0]) / len(cols)
    spread = sum(((c - mean) * (c - mean) for c in means_of), F.lit(0.0)) / len(cols)
    return rows.select(
        "node",
        (F.col("degree") / F.greatest(top.select("d").scalar(), F.lit(1))).alias("degree_norm"),
        mean.alias("nbr_mean"),
        F.sqrt(spread).alias("nbr_std"),
        "global_rank",
        (F.col("walks") / F.greatest(top.select("w").scalar(), F.lit(1))).alias("walks_norm"),
    )


def temporal_features(m: DataFrame, values: DataFrame, cols: Sequence[str], days: DataFrame) -> DataFrame:
    """Own columns, neighbour means and maxima, squared norm, day cycle, proximity, degree.

    ``days(node, day)`` gives a day number.
    """
    s = m if "n" in m.columns else cut(shared(m))
    rows = (
        values.select("node", *cols)
        .join(neighbor_means(s, values, cols), "node", "left")
        .join(neighbor_maxima(s, values, cols), "node", "left")
        .join(days, "node", "left")
        .join(temporal_proximity(s, days), "node", "left")
        .na.fill(0)
    )
    rows = cut(rows)
    top = rows.agg(F.max("degree")).scalar()
    squares = [F.col(c) * F.col(c) for c in cols]
    angle = F.col("day") * F.lit(2 * math.pi / 30)
    return rows.select(
        "node",
        *cols,
        *[f"mean_{c}" for c in cols],
        *[f"max_{c}" for c in cols],
        sum(squares[1:], squares[0]).alias("self_norm"),
        "day",
        F.sin(angle).alias("day_sin"),
        F.cos(angle).alias("day_cos"),
        "proximity",
        (F.col("degree") / (top + F.lit(1e-9))).alias("degree_norm"),
    )


# -- embeddings ---------------------------------------------------------------


def fit_scale(features: DataFrame, cols: Sequence[str]) -> tuple[list[float], list[float]]:
    """Means and population stds (0 becomes 1): two numbers per column."""
    row = features.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    k = len(cols)
    return [row[f"m{i}"] for i in range(k)], [row[f"s{i}"] or 1.0 for i in range(k)]


def random_weights(n_features: int, d: int = 64, seed: int = 42, scale: float = 0.01) -> dict[str, np.ndarray]:
    """Untrained projection, mixing and attention weights (size fixed by the layout)."""
    rng = np.random.RandomState(seed)
    return {
        "project": rng.randn(n_features, d) * scale,
        "mix": rng.randn(d, d) * scale,
        "attend": rng.randn(2 * d) * scale,
    }


def project(features: DataFrame, cols: Sequence[str], mean, std, weights) -> DataFrame:
    """(node, h, g, s, t): h = tanh(scaled x W), g = h mixed, s/t its attention scores."""
    cols = list(cols)
    mu, sd = np.asarray(mean), np.asarray(std)
    w, mix, att = weights["project"], weights["mix"], weights["attend"]
    d = w.shape[1]

    def run(batches):
        for pdf in batches:
            x = (pdf[cols].to_numpy(dtype=float) - mu) / sd
            h = np.tanh(x @ w)
            g = h @ mix
            yield pdf[["node"]].assign(h=list(h), g=list(g), s=g @ att[:d], t=g @ att[d:])

    kind = features.schema["node"].dataType.simpleString()
    return features.select("node", *cols).mapInPandas(
        run, f"node {kind}, h array<double>, g array<double>, s double, t double"
    )


def attention_sides(m: DataFrame, rows: DataFrame, cols: Sequence[str], slope: float = 0.2, **kw) -> DataFrame:
    """Neighbour sums weighted by exp(LeakyReLU(s + t)) in two parts, for nodes with a neighbour.

    ``rows(node, s, t, *cols)``: s is a node's own score, t its score as a neighbour.  LeakyReLU
    has two slopes, so a weight is a product of a part in s and a part in t on either side
    of t = -s, and two running sums over the neighbours in the order of t give the total; no
    pair is formed.  Weights are divided by their bound over all nodes, exp(LeakyReLU(s + max t)),
    which quotients of two such sums do not notice.

    (node, above, below, steep, flat, l_total, l_<col>.., h_total, h_<col>..): a node's sum is
    above * h + below * l; ``steep`` and ``flat`` are its own parts as a neighbour.
    """
    names = ["total", *cols]
    top = rows.agg(F.max("t").alias("top"))
    reach = F.col("s") + F.col("top")
    bound = F.when(reach > 0, reach).otherwise(reach * slope)
    ready = cut(
        rows.withColumn("top", top.scalar())
        .withColumn("total", F.lit(1.0))
        .withColumns(
            {
                "x": F.col("t"),
                "at": -F.col("s"),
                "above": F.exp(reach - bound),
                "below": F.exp(reach * slope - bound),
                "steep": F.exp(F.col("t") - F.col("top")),
                "flat": F.exp(F.lit(slope) * (F.col("t") - F.col("top"))),
            }
        )
        .select(
            *["node", "x", "at", "above", "below", "steep", "flat"],
            *[(F.col("flat") * F.col(c)).alias(f"l_{c}") for c in names],
            *[(F.col("steep") * F.col(c)).alias(f"h_{c}") for c in names],
        )
    )
    low, high = [f"l_{c}" for c in names], [f"h_{c}" for c in names]
    sums = threshold_sums(m, ready.select("node", "x", "at", *low, *high), low, high, **kw)
    return sums.join(ready.select("node", "above", "below", "steep", "flat"), "node")


def attention_sums(m: DataFrame, rows: DataFrame, cols: Sequence[str], slope: float = 0.2, **kw) -> DataFrame:
    """(node, total, <cols>..): the parts of ``attention_sides`` together."""
    sides = attention_sides(m, rows, cols, slope, **kw)
    whole = lambda c: F.col("above") * F.col(f"h_{c}") + F.col("below") * F.col(f"l_{c}")
    return sides.select("node", *[whole(c).alias(c) for c in ("total", *cols)])


def attention(m: DataFrame, hidden: DataFrame, d: int, slope: float = 0.2, **kw) -> DataFrame:
    """(node, att_0..): softmax-weighted neighbour mean of ``g``, over ``hidden(node, g, s, t)``.

    The score of an edge is LeakyReLU(s + t).  A node without neighbours keeps its own ``g``.
    """
    names = [f"g_{i}" for i in range(d)]
    wide = hidden.select("node", "s", "t", *[F.col("g")[i].alias(n) for i, n in enumerate(names)])
    pulled = attention_sums(m, wide, names, slope, **kw)
    own = wide.select("node", *[F.col(n).alias(f"own_{i}") for i, n in enumerate(names)])
    return own.join(pulled, "node", "left").select(
        "node",
        *[F.tanh(F.coalesce(F.col(n) / F.col("total"), F.col(f"own_{i}"))).alias(f"att_{i}") for i, n in enumerate(names)],
    )


def embed(
    features: DataFrame,
    cols: Sequence[str],
    m: DataFrame,
    visits: DataFrame,
    scale: tuple,
    weights,
    k: int = 3,
    tau: float | None = 7.0,
) -> DataFrame:
    """(node, att_0.., agg_0..): attention part and neighbour-mean part.

    Attention runs over the graph ``m``.  The mean runs over the ±k day graph of
    ``visits`` without listing its pairs, weighted by exp(-gap / tau), or plain with
    ``tau=None``.  To embed one split, pass its members and its visits only.
    """
    d = weights["project"].shape[1]
    hidden = cut(project(features, cols, *scale, weights))
    names = [f"h_{i}" for i in range(d)]
    wide = hidden.select("node", *[F.col("h")[i].alias(n) for i, n in enumerate(names)])
    if tau is None:
        mean = neighbor_means(members(visits, k), wide, names)
    else:
        sums = decayed_sums(visits, wide, names, k, tau)
        mean = sums.select("node", *[(F.col(f"sum_{n}") / F.col("weight")).alias(f"mean_{n}") for n in names])
    agg = wide.join(mean, "node", "left").select(
        "node", *[F.tanh(F.coalesce(F.col(f"mean_{n}"), F.col(n))).alias(f"agg_{i}") for i, n in enumerate(names)]
    )
    return attention(m, hidden, d).join(agg, "node")
