"""Classifiers that see the graph: embeddings or neighbour features, then a learner."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators import embedding as E
from coloom.operators.graph_networks import Network, start_weights
from coloom.operators.metrics import classification_metrics
from coloom.operators.models import evaluate
from coloom.session import cut


def embedded(
    table: DataFrame,
    cols: Sequence[str],
    m: DataFrame,
    visits: DataFrame,
    d: int = 64,
    seed: int = 42,
    k: int = 3,
    tau: float | None = 7.0,
) -> DataFrame:
    """(case_id, split, label, att_.., agg_..): training and test rows embedded apart.

    A node only sees neighbours of its own split, and the scaling comes from the
    training rows.  ``tau=None`` leaves out the time decay.
    """
    table = table.withColumn("node", F.col("case_id"))
    scale = E.fit_scale(table.where("split = 'train'"), cols)
    weights = E.random_weights(len(cols), d, seed)
    out = None
    for name in ("train", "test"):
        rows = table.where(F.col("split") == name)
        mine = rows.select("case_id")
        part = E.embed(
            rows,
            cols,
            m.select("node", "clique").join(rows.select("node"), "node", "left_semi"),
            visits.join(mine, "case_id", "left_semi"),
            scale,
            weights,
            k,
            tau,
        )
        out = part if out is None else out.unionByName(part)
    return cut(out.join(table.select("node", "case_id", "split", "label"), "node").drop("node"))


def embedding_scores(table: DataFrame, cols, m, visits, d: int = 64, seed: int = 42, k: int = 3, tau: float | None = 7.0, **kw) -> DataFrame:
    """Scores of an MLP on the embedding."""
    rows = embedded(table, cols, m, visits, d, seed, k, tau)
    names = [f"{p}_{i}" for p in ("att", "agg") for i in range(d)]
    return evaluate("MLP", rows, names, seed, **{"hidden": [64, 32], **kw})


def convolution_scores(table: DataFrame, cols, m: DataFrame, hidden: int = 64, seed: int = 42, **kw) -> DataFrame:
    """Scores of a logistic regression on two graph-convolution passes.

    Propagate, mix through fixed random weights with a rectifier, propagate again;
    only the output layer is trained.
    """
    values = table.select(F.col("case_id").alias("node"), *cols)
    first = E.gcn_propagate(m, values, cols)
    weights = np.random.RandomState(seed).randn(len(cols), hidden) * 0.1
    names, inputs = [f"g_{i}" for i in range(hidden)], list(cols)

    def mix(batches):
        for pdf in batches:
            h = np.maximum(pdf[inputs].to_numpy(dtype=float) @ weights, 0.0)
            yield pd.concat([pdf[["node"]], pd.DataFrame(h, columns=names, index=pdf.index)], axis=1)

    kind = table.schema["case_id"].dataType.simpleString()
    mixed = cut(first.mapInPandas(mix, f"node {kind}, " + ", ".join(f"{n} double" for n in names)))
    second = E.gcn_propagate(m, mixed, names).withColumnRenamed("node", "case_id")
    rows = cut(table.select("case_id", "split", "label").join(second, "case_id"))
    return evaluate("LR", rows, names, seed, **kw)


def attention_scores(table: DataFrame, cols, m: DataFrame, d: int = 64, seed: int = 42, **kw) -> DataFrame:
    """Scores of a logistic regression on one attention pass over the graph."""
    table = table.withColumn("node", F.col("case_id"))
    scale = E.fit_scale(table.where("split = 'train'"), cols)
    hidden = cut(E.project(table, cols, *scale, E.random_weights(len(cols), d, seed, 0.1)))
    att = E.attention(m, hidden, d).withColumnRenamed("node", "case_id")
    rows = cut(table.select("case_id", "split", "label").join(att, "case_id"))
    return evaluate("LR", rows, [f"att_{i}" for i in range(d)], seed, **kw)


def structure_scores(table: DataFrame, cols, m: DataFrame, seed: int = 42, **kw) -> DataFrame:
    """Scores of an MLP on the own columns and five structural features.

    Do not pass a graph that also defines the label: its degree gives the label away.
    """
    extra = E.structure_features(m, table.withColumn("node", F.col("case_id")), cols)
    rows = cut(table.join(extra.withColumnRenamed("node", "case_id"), "case_id"))
    names = [*cols, "degree_norm", "nbr_mean", "nbr_std", "global_rank", "walks_norm"]
    return evaluate("MLP", rows, names, seed, **{"hidden": [128, 64], **kw})


def temporal_scores(table: DataFrame, cols, m: DataFrame, days: DataFrame, seed: int = 42, **kw) -> DataFrame:
    """Scores of boosted trees on own, neighbour and time features."""
    values = table.withColumn("node", F.col("case_id"))
    extra = E.temporal_features(m, values, cols, days)
    names = [c for c in extra.columns if c != "node"]
    rows = cut(table.select("case_id", "split", "label").join(extra.withColumnRenamed("node", "case_id"), "case_id"))
    return evaluate("GBM", rows, names, seed, **kw)


def network_scores(kind: str, table: DataFrame, cols, m: DataFrame, hidden: int = 16, epochs: int = 30, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Scores of a graph network trained through both layers, with the first and the last loss.

    Columns are scaled by the training rows.  The graph has all rows, as the network is
    transductive; labels are those of the training rows alone.
    """
    mean, std = E.fit_scale(table.where("split = 'train'"), cols)
    scaled = [((F.col(c) - mu) / sd).alias(c) for c, mu, sd in zip(cols, mean, std)]
    rows = cut(table.select(F.col("case_id").alias("node"), "label", "split", *scaled))
    net = Network(kind, rows, cols, m)
    weights, losses = net.train(start_weights(kind, len(cols), hidden, seed), epochs, rate)
    test = net.scores(weights).where(~F.col("train")).join(rows.where("split = 'test'").select("node", "label"), "node")
    return classification_metrics(test).withColumns({"first_loss": F.lit(losses[0]), "last_loss": F.lit(losses[-1])})
