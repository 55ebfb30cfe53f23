"""Graph networks of two layers, trained end to end.

A step goes over the graph by neighbour sums of a few scalars per node and over the rows
by matrix products of Arrow batches; weights are small and travel with the tasks.  Gradients
are summed in each partition, then by Spark.  What a step writes is one table of nodes, and
the next step does not read the one before.

* ``gcn``: logits A relu(A X W) u + b with A = D^-1/2 (I + adjacency) D^-1/2.  A is
  symmetric, so the error goes back by the same sum.
* ``gat``: one attention head.  With h = X W a node's scores are s = h a1 and t = h a2, its
  value q = h v; its logit is the mean of its neighbours' q, weighted by
  softmax(LeakyReLU(s_i + t_j)), plus b.  The weights' derivatives are such sums as well: in
  s over the neighbours in the order of t, in t over them in the order of s.  Nodes without
  neighbours attend to themselves.

The loss is the mean cross entropy of the training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators.colocation import shared
from coloom.operators.embedding import attention_sides, gcn_propagate
from coloom.operators.neighbors import neighbor_sums, repeated, threshold_sums
from coloom.session import cut

Weights = dict[str, np.ndarray]


def start_weights(kind: str, inputs: int, hidden: int, seed: int = 42) -> Weights:
    rng = np.random.RandomState(seed)
    w = {"W": rng.randn(inputs, hidden) * np.sqrt(2.0 / inputs), "b": np.zeros(1)}
    if kind == "gcn":
        return w | {"u": rng.randn(hidden) * np.sqrt(1.0 / hidden)}
    return w | {n: rng.randn(hidden) * np.sqrt(1.0 / hidden) for n in ("a1", "a2", "v")}


class Network:
    """The rows of one table and graph, ready for passes.

    ``table(node, label, split, *cols)`` has each node once; rows of split "train" are
    learnt from.  ``m(node, clique)`` is the graph.  Columns are scaled beforehand.
    """

    def __init__(self, kind: str, table: DataFrame, cols: Sequence[str], m: DataFrame) -> None:
        self.kind, self.cols = kind, list(cols)
        s = m if "n" in m.columns else cut(shared(m))
        self.s = repeated(s)
        facts = table.select("node", F.col("label").cast("double").alias("y"), (F.col("split") == "train").alias("train"))
        if kind == "gcn":
            inputs = gcn_propagate(s, table.select("node", *self.cols), self.cols)
            degree = neighbor_sums(self.s).select("node", "degree")
            root = F.sqrt(1 / (F.coalesce("degree", F.lit(0)) + 1.0)).alias("root")
            inputs = inputs.join(degree, "node", "left").select("node", root, *self.cols)
        else:
            inputs = table.select("node", F.lit(1.0).alias("root"), *self.cols)
        self.rows = cut(facts.join(inputs, "node").select("node", "y", "train", "root", F.array(*self.cols).alias("x")))
        self.n = self.rows.where("train").count()
        self.type = self.rows.schema["node"].dataType.simpleString()

    def _each(self, rows: DataFrame, names: Sequence[str], make: Callable[[np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
        """``rows`` without x, with a column for each array that ``make`` gives for a batch of x."""
        keep = [c for c in rows.columns if c != "x"]

        def run(batches):
            for pdf in batches:
                x = np.stack(pdf["x"].to_numpy())
                yield pd.concat([pdf[keep], pd.DataFrame(dict(zip(names, make(x))), index=pdf.index)], axis=1)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.mapInPandas(run, f"{schema}, " + ", ".join(f"{n} double" for n in names))

    def _gradient(self, rows: DataFrame, given: Sequence[str], w: Weights, make: Callable[..., Weights]) -> Weights:
        """The sum over all rows of ``make(x, *given)``, shaped like ``w``."""
        shapes = {k: v.shape for k, v in w.items()}

        def run(batches):
            total = {k: np.zeros(s) for k, s in shapes.items()}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for k, g in make(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in given)).items():
                    total[k] += g
            flat = np.concatenate([total[k].ravel() for k in shapes])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "g"])

        parts = rows.select("x", *given).mapInArrow(run, "i long, g double")
        flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()))
        for r in parts.groupBy("i").agg(F.sum("g").alias("g")).collect():
            flat[r["i"]] = r["g"]
        out, at = {}, 0
        for k, s in shapes.items():
            out[k] = flat[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        return out

    # -- one pass -------------------------------------------------------------

    def _pull(self, values: DataFrame, col: str) -> DataFrame:
        """``values`` with ``pulled``: A times ``col``, which is scaled by root already."""
        sums = neighbor_sums(self.s, values.select("node", col), [col]).select("node", F.col(f"sum_{col}").alias("around"))
        return values.join(sums, "node", "left").withColumn("pulled", F.col("root") * (F.coalesce("around", F.lit(0.0)) + F.col(col))).drop("around")

    def _error(self, logits: DataFrame) -> DataFrame:
        """With the loss of each training row and the derivative of the mean loss by its logit."""
        z, y = F.col("z"), F.col("y")
        loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
        return logits.withColumns(
            {
                "loss": F.when(F.col("train"), loss / self.n).otherwise(0.0),
                "dz": F.when(F.col("train"), (1 / (1 + F.exp(-z)) - y) / self.n).otherwise(0.0),
            }
        )

    def logits(self, w: Weights) -> DataFrame:
        """(node, y, train, z, ..) of every row."""
        b = float(w["b"][0])
        if self.kind == "gcn":
            out = self._each(self.rows, ["p"], lambda x: [np.maximum(x @ w["W"], 0.0) @ w["u"]])
            out = cut(out.withColumn("p", F.col("root") * F.col("p")))
            return self._pull(out, "p").withColumn("z", F.col("pulled") + b)
        out = self._each(self.rows, ["s", "t", "q"], lambda x: [(h := x @ w["W"]) @ w["a1"], h @ w["a2"], h @ w["v"]])
        out = cut(out)
        sides = attention_sides(self.s, out, ["q"])
        total = F.col("above") * F.col("h_total") + F.col("below") * F.col("l_total")
        around = F.col("above") * F.col("h_q") + F.col("below") * F.col("l_q")
        out = out.join(sides, "node", "left").withColumn("total", total).withColumn("mean", F.coalesce(around / total, F.col("q")))
        return out.withColumn("z", F.col("mean") + b)

    def step(self, w: Weights) -> tuple[float, Weights]:
        """The loss and its gradient."""
        known = cut(self._error(self.logits(w)))
        loss = known.agg(F.sum("loss")).first()[0]
        if self.kind == "gcn":
            back = self._pull(known.select("node", "root", "dz", (F.col("root") * F.col("dz")).alias("e")), "e")
            rows = self.rows.select("node", "x").join(back.select("node", "dz", F.col("pulled").alias("dp")), "node")

            def gcn(x, dz, dp):
                h = np.maximum(x @ w["W"], 0.0)
                return {"u": h.T @ dp, "W": x.T @ (np.outer(dp, w["u"]) * (h > 0)), "b": np.array([dz.sum()])}

            return loss, self._gradient(rows, ["dz", "dp"], w, gcn)
        rows = self.rows.select("node", "x").join(self._back(known), "node")

        def gat(x, dz, ds, dt, dq):
            h = x @ w["W"]
            dh = np.outer(ds, w["a1"]) + np.outer(dt, w["a2"]) + np.outer(dq, w["v"])
            return {"W": x.T @ dh, "a1": h.T @ ds, "a2": h.T @ dt, "v": h.T @ dq, "b": np.array([dz.sum()])}

        return loss, self._gradient(rows, ["dz", "ds", "dt", "dq"], w, gat)

    def _back(self, known: DataFrame, slope: float = 0.2) -> DataFrame:
        """(node, dz, ds, dt, dq): derivatives by a node's scores and value."""
        c = F.col
        off = lambda side: c(f"{side}_q") - c("mean") * c(f"{side}_total")
        ds = c("dz") / c("total") * (c("above") * off("h") + slope * c("below") * off("l"))
        # As seen from the neighbours, who read a node in the order of s.
        share = {"h_e": c("above") * c("dz") / c("total"), "l_e": c("below") * c("dz") / c("total")}
        sent = known.withColumns({"ds": F.coalesce(ds, F.lit(0.0)), **{k: F.coalesce(v, F.lit(0.0)) for k, v in share.items()}})
        sent = cut(sent.withColumns({"h_m": c("h_e") * c("mean"), "l_m": c("l_e") * c("mean")}))
        rows = sent.select("node", c("s").alias("x"), (-c("t")).alias("at"), "l_e", "l_m", "h_e", "h_m")
        got = threshold_sums(self.s, rows, ["l_e", "l_m"], ["h_e", "h_m"])
        both = sent.select("node", "dz", "ds", "q", "steep", "flat", "total").join(got, "node", "left")
        dq = c("steep") * c("h_e") + c("flat") * c("l_e")
        dt = c("steep") * (c("q") * c("h_e") - c("h_m")) + slope * c("flat") * (c("q") * c("l_e") - c("l_m"))
        alone = c("total").isNull()
        return both.select("node", "dz", "ds", F.when(alone, 0.0).otherwise(dt).alias("dt"), F.when(alone, c("dz")).otherwise(dq).alias("dq"))

    # -- training -------------------------------------------------------------

    def train(self, w: Weights, epochs: int = 20, rate: float = 0.05) -> tuple[Weights, list[float]]:
        """The weights after ``epochs`` steps of Adam, and the loss before each."""
        mean, square, losses = {k: 0.0 for k in w}, {k: 0.0 for k in w}, []
        for i in range(1, epochs + 1):
            loss, grad = self.step(w)
            losses.append(loss)
            mean = {k: 0.9 * mean[k] + 0.1 * g for k, g in grad.items()}
            square = {k: 0.999 * square[k] + 0.001 * g * g for k, g in grad.items()}
            w = {k: v - rate * (mean[k] / (1 - 0.9**i)) / (np.sqrt(square[k] / (1 - 0.999**i)) + 1e-8) for k, v in w.items()}
        return w, losses

    def scores(self, w: Weights) -> DataFrame:
        """(node, y, train, score) of every row."""
        return self.logits(w).select("node", "y", "train", (1 / (1 + F.exp(-F.col("z")))).alias("score"))
