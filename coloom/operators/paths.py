"""Shortest-path dependencies of components of bounded size, sources spread over tasks.

``most`` pairs of classes at most make a component small: a task then gets its edges as
arrays with some of its sources, ``TASK_CELLS`` cells at most or one source.  Each (source, node)
is a cell; the sources of a block, of one component or of many, are walked together, wave by wave.
A block holds about ``CELLS`` cells, or one source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coloom.operators.colocation import pairs
from coloom.operators.components import components, group_stars
from coloom.session import cut

# Most pairs of classes of a component whose paths are walked inside tasks.
PAIRS = 1 << 18
# Cells that are walked at a time, and cells of the sources that go out with one copy of a graph, about.
CELLS, TASK_CELLS = 1 << 20, 1 << 24
# Edges of the search for components that one partition works on.
ONE_TASK = 1 << 17


def small_components(m: DataFrame, most: int = PAIRS) -> DataFrame:
    """(node, component, small) of ``m(node, clique)`` for all nodes that share a group with somebody."""
    of = cut(components(group_stars(m), ONE_TASK))
    sizes = m.groupBy("clique").agg(F.min("node").alias("node"), F.count(F.lit(1)).cast("double").alias("n"))
    per = sizes.join(of, "node").groupBy("component").agg((F.sum(F.col("n") * (F.col("n") - 1) / 2) <= most).alias("small"))
    return cut(of.join(per, "component").select("node", "component", "small"))


def component_dependencies(m: DataFrame, of: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, dep): how much a node lies on the shortest paths inside its component, all sources by their weights.

    ``m(node, clique)``, ``of(node, component)`` and ``weights(node, weight)`` of small components.
    """
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    nodes = cut(of.join(weights, "node").select("node", "component", "weight", place.alias("i")))
    ends = nodes.select("node", "component", "i")
    arcs = (
        pairs(m)
        .join(ends.withColumnsRenamed({"node": "src", "i": "a"}), "src")
        .join(ends.select(F.col("node").alias("dst"), F.col("i").alias("b")), "dst")
    )
    graphs = (
        nodes.groupBy("component")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "weight"))), lambda x: x["weight"]).alias("weights"))
        .join(arcs.groupBy("component").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "component")
    )
    size = F.size("weights")
    step = F.greatest(F.lit(1), F.floor(F.lit(TASK_CELLS) / size)).cast("int")
    jobs = graphs.select("*", F.explode(F.sequence(F.lit(0), size - 1, step)).alias("first"), step.alias("step"))
    cells = nodes.groupBy("component").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0
    given = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = jobs.repartition(max(given, int(cells // TASK_CELLS) + 1), "component", "first")
    kind = nodes.schema["component"].dataType.simpleString()
    walked = spread.mapInArrow(_walk_batches, f"component {kind}, i int, dep double")
    total = walked.groupBy("component", "i").agg(F.sum("dep").alias("dep"))
    return nodes.join(total, ["component", "i"]).select("node", "dep")


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, i, dep) of each row's sources, the rows of about ``CELLS`` cells at a time."""

    def walked(jobs: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(w) for _, w, *_ in jobs])
        dep = dependencies([job[1:] for job in jobs])
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        which = pa.array(np.repeat(np.arange(len(jobs)), sizes))
        names = pa.concat_arrays([job[0] for job in jobs]).take(which)
        return pa.RecordBatch.from_arrays([names, pa.array(places), pa.array(dep)], ["component", "i", "dep"])

    held, cells = [], 0
    for batch in batches:
        at = {name: batch.column(name) for name in batch.schema.names}
        for r in range(batch.num_rows):
            w, a, b = (at[c][r].values.to_numpy(zero_copy_only=False) for c in ("weights", "a", "b"))
            first = at["first"][r].as_py()
            last = min(first + at["step"][r].as_py(), len(w))
            while first < last:
                until = min(last, first + max(1, (CELLS - cells) // len(w)))
                held.append((at["component"].slice(r, 1), w, a, b, first, until))
                cells += len(w) * (until - first)
                first = until
                if cells + len(w) > CELLS:
                    yield walked(held)
                    held, cells = [], 0
    if held:
        yield walked(held)


def dependencies(jobs: list[tuple]) -> np.ndarray:
    """The dependency of every node of each job, one job after the other.

    A job is (weights, a, b, first, last): a connected graph of weighted nodes 0, 1, .. with the
    edges (a, b), and the range of its sources.  A source is one node of its class, and counts by its weight.
    """
    sizes = np.array([len(j[0]) for j in jobs])
    counts = np.array([last - first for *_, first, last in jobs])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    weight = np.concatenate([j[0] for j in jobs])
    a = np.concatenate([j[1] + o for j, o in zip(jobs, offset)])
    b = np.concatenate([j[2] + o for j, o in zip(jobs, offset)])
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    other = np.concatenate([b, a])[order]
    degree = np.bincount(np.concatenate([a, b]), minlength=offset[-1])
    begin = np.cumsum(degree) - degree

    source = np.concatenate([np.arange(o + first, o + last) for (*_, first, last), o in zip(jobs, offset)])
    length = np.repeat(sizes, counts)
    # The cell of a source's node v is ``base + v``.
    base = np.cumsum(length) - length - np.repeat(offset[:-1], counts)
    fresh, place = np.ones(length.sum(), bool), np.empty(length.sum(), np.int64)
    fresh[base + source] = False
    # A wave is (nodes, places of their sources, paths); a step from one to the next is (ends, starts) of its arcs.
    waves, steps = [(source, np.arange(len(source)), np.ones(len(source)))], []
    give = waves[0][2]
    while True:
        v, s, _ = waves[-1]
        d = degree.take(v)
        came = np.repeat(np.arange(len(v)), d)
        arc = np.arange(len(came)) + (begin.take(v) - (np.cumsum(d) - d)).take(came)
        cell = other.take(arc) + base.take(s).take(came)
        new = np.flatnonzero(fresh.take(cell))
        if not len(new):
            break
        cell, came = cell.take(new), came.take(new)
        row = np.arange(len(cell))
        place[cell] = row
        one = np.flatnonzero(place.take(cell) == row)
        front = cell.take(one)
        place[front] = row[: len(front)]
        fresh[front] = False
        to = place.take(cell)
        paths = np.bincount(to, give.take(came), len(front))
        s = s.take(came.take(one))
        v = front - base.take(s)
        give = paths * weight.take(v)
        waves.append((v, s, paths))
        steps.append((to, came))
    total, dep = np.zeros(offset[-1]), np.zeros(len(waves[-1][0]))
    for (v, s, paths), (before, _, paths_before), (to, came) in zip(waves[:0:-1], waves[-2::-1], steps[::-1]):
        total += np.bincount(v, dep * weight.take(source.take(s)), offset[-1])
        share = weight.take(v) * (1 + dep) / paths
        dep = np.bincount(came, share.take(to), len(before)) * paths_before
    return total
