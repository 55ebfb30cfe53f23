"""Sums over everyone in a union of groups, each counted once, without a row for a pair.

Groups are numbered.  Two sets of groups that meet have one lowest group in common, so
a pair of them counts in the cell of that group alone: there the groups below it
(``prior``) of the one have none in common with those of the other.  A cell is a group
of rows that Spark shuffles; large ones are dealt to several tasks.  Within a task
either all pairs are tried on bit sets in small tiles, or totals over all sets of groups
are kept in a table that has one entry for each subset, whichever is less work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.session import cut

# Rows of a cell that one task takes from either side.
BLOCK = 400_000
# Rows of the two sides that are tried on each other at a time.
TILE = 512, 4096


def union_sums(
    sets: DataFrame, asks: DataFrame, points: DataFrame, low: Sequence[str], high: Sequence[str], bits: int, block: int = BLOCK
) -> DataFrame:
    """(sig, at, <low>.., <high>..) for each row of ``asks(sig, at)``, in double precision.

    ``sets(sig, groups)`` has the sorted numbers of the groups of each signature.  ``low`` is summed
    over the ``points(sig, x, *low, *high)`` whose groups meet those of the asking signature (its own
    points are among them) and have x <= at, ``high`` over those with x > at.  Tables have at most
    2**bits entries.
    """
    low, high = list(low), list(high)
    cells = sets.select("sig", "groups", F.posexplode("groups").alias("i", "g")).select("sig", "g", F.slice("groups", 1, F.col("i")).alias("prior"))
    rows = asks.select("sig").unionByName(points.select("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.select("sig", "g").join(rows, "sig").groupBy("g").agg(F.ceil(F.sum("n") / (2 * block)).alias("blocks"))
    cells = cut(cells.join(sizes, "g"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("sig", by), F.col("blocks"))
        out = df.join(cells, "sig").select("*", mine.alias(own), every.alias(other)).drop("blocks")
        return out.select(*[F.col(c).alias(c) for c in out.columns])  # columns of its own, though both sides come from ``cells``

    cols = [*low, *high]
    left = dealt(asks.select("sig", "at"), "at", "i", "j")
    right = dealt(points.select("sig", "x", *[F.col(c).cast("double").alias(c) for c in cols]), "x", "j", "i")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        at, x = left["at"].to_numpy(), right["x"].to_numpy()
        a, b, dims = bit_sets(left["prior"], right["prior"])
        values = np.array([right[c].to_numpy() for c in cols])
        order = np.argsort(x, kind="stable")
        upto = np.searchsorted(x[order], at, "right")
        k = len(low)
        out = [leading_sums(a, upto, b[order], values[:k, order], dims, bits)]
        if high:
            out.append(leading_sums(a, len(x) - upto, b[order[::-1]], values[k:, order[::-1]], dims, bits))
        sig = left["sig"].combine_chunks()
        sig = pa.StructArray.from_arrays(sig.flatten(), [f.name for f in sig.type])  # of fields that may be null, as declared
        return pa.table([sig, left["at"], *np.concatenate(out)], names=["sig", "at", *cols])

    kind = sets.schema["sig"].dataType.simpleString()
    told = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j"))
    told = told.applyInArrow(cell, f"sig {kind}, at double, " + ", ".join(f"`{c}` double" for c in cols))
    return told.groupBy("sig", "at").agg(*[F.sum(c).alias(c) for c in cols])


def bit_sets(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """The lists of both sides as rows of 64-bit words, and how many bits count: a number on one side only has none."""
    sides = [(lists.combine_chunks().flatten().to_numpy(), np.asarray(lists.combine_chunks().value_lengths())) for lists in (left, right)]
    known = np.intersect1d(sides[0][0], sides[1][0])
    out = []
    for flat, lengths in sides:
        row, at = np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(known, flat)
        if len(known):
            own = known[np.minimum(at, len(known) - 1)] == flat
        else:
            own = np.zeros(len(flat), bool)
        words = np.zeros((len(lengths), max(1, -(-len(known) // 64))), np.uint64)
        np.bitwise_or.at(words, (row[own], at[own] // 64), np.uint64(1) << (at[own] % 64).astype(np.uint64))
        out.append(words)
    return out[0], out[1], len(known)


def leading_sums(a: np.ndarray, upto: np.ndarray, b: np.ndarray, values: np.ndarray, dims: int, bits: int) -> np.ndarray:
    """For each set of ``a``: the sums of ``values`` over those of the first ``upto`` sets of ``b`` that have no bit of it."""
    out = np.zeros((len(values), len(a)))
    if not len(a) or not len(b):
        return out
    below = min(dims, bits)
    table = (below + 1.0) * 2**below * len(values)
    tops, of = np.unique(a[:, 0] >> np.uint64(below), return_inverse=True) if dims <= 63 else (None, None)
    if dims > 63 or len(tops) * table > 2.0 * len(a) * len(b):
        _tiles(out, np.arange(len(a)), a, upto, b, values)
        return out
    mask = np.uint64(2**below - 1)
    for i, top in enumerate(tops):
        mine = np.flatnonzero(of == i)
        free = np.flatnonzero((b[:, 0] >> np.uint64(below)) & top == 0)
        _table(out, mine, a, np.searchsorted(free, upto[mine]), b[free], values[:, free], mask, below, table)
    return out


def _table(out, mine, a, upto, b, values, mask, below, table) -> None:
    """``leading_sums`` for the rows ``mine``: totals of all steps before the one that ``upto`` ends in, and that one in tiles."""
    inside = upto[(upto > 0) & (upto < len(b))]
    steps = int(np.clip(np.sqrt(2.0 * len(inside) * len(b) / table), 1, 256)) if len(inside) else 1
    size = max(1, -(-len(b) // steps))
    step = upto // size
    sums = np.zeros((len(values), 2**below))
    keys = (b[:, 0] & mask).astype(np.int64)
    away = (~a[mine, 0] & mask).astype(np.int64)
    for i in range(int(step.max()) + 1):
        if i:
            some = slice((i - 1) * size, i * size)
            more = np.array([np.bincount(keys[some], v[some], 2**below) for v in values])
            for bit in range(below):  # each entry becomes the total of its subsets
                pairs = more.reshape(len(values), -1, 2, 2**bit)
                pairs[:, :, 1] += pairs[:, :, 0]
            sums += more
        here = np.flatnonzero(step == i)
        out[:, mine[here]] += sums[:, away[here]]
        some = slice(i * size, (i + 1) * size)
        _tiles(out, mine[here], a, upto[here] - i * size, b[some], values[:, some])


def _tiles(out, rows, a, upto, b, values) -> None:
    """Adds to ``out[:, rows]`` by trying each of them on the first ``upto`` sets of ``b``."""
    order = np.argsort(upto, kind="stable")
    rows, upto = rows[order], upto[order]
    for r in range(0, len(rows), TILE[0]):
        some, end = rows[r : r + TILE[0]], upto[r : r + TILE[0]]
        for c in range(0, min(len(b), int(end.max(initial=0))), TILE[1]):
            other = b[c : c + TILE[1]]
            both = a[some, :1] & other[None, :, 0]
            for w in range(1, b.shape[1]):
                both |= a[some, w : w + 1] & other[None, :, w]
            free = both == 0
            if end.min() < c + len(other):
                free &= np.arange(c, c + len(other)) < end[:, None]
            out[:, some] += (free @ values[:, c : c + TILE[1]].T).T
