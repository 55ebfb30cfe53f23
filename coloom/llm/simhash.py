"""SimHash near-duplicates found with the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint.  Two fingerprints with at most ``radius``
differing bits are linked.  The links are found as follows:

1. The bits are dealt to ``parts`` groups so that correlated bits stand together;
   the correlations come from all fingerprints.
2. Every fingerprint gets thresholds t_1..t_m, -1 or more, that add up to
   ``radius - parts + 1``.  Whatever the thresholds, a fingerprint within the
   radius differs in at most t_i bits in some group i.  The allocation with the
   lowest estimated number of candidates is found by dynamic programming; the
   estimates come from counts over all fingerprints.
3. A fingerprint probes the values within t_i bits of its own in each group, and
   what it meets there is verified on all 64 bits.

A value that more than ``crowd`` fingerprints share is not verified pair by pair.
Its members and visitors write all fingerprints within half the radius of their
own; those who write the same one are within the radius of each other, which
gives the same links in a number of rows that is linear in the members.

Equal fingerprints are one node, so copies cost nothing.

Nulls and empty texts have the fingerprint 0 and are linked like any other.
Every input row gives one output row; rows with a null id are linked but name no
component unless nobody else is there (then the component is null).  Repeated
ids keep one row each.  Extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from coloom.llm.common import raw, table
from coloom.operators.components import components
from coloom.session import cut

BITS = 64
#: Bits in one table of value counts; all tables together have (64 / 8) * 256 cells.
CELL = 8
#: Bits set in each byte.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)
#: What one probe costs, in candidates.
PROBE_COST = 1.0


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the lower-cased word shingles, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], gaps + 1))[:n].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        cells = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        ones += _ones(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in cells], "<u8"))
    return _majority(ones, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of hashed shingles; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += _ones(hashes[at : at + (1 << 16)].astype("<u8"))
    return _majority(ones, len(hashes))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: str, width: int = 3, seed: int = 42):
    """The fingerprint of a text column, as a column of longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width, seed) for t in texts.to_pylist()], pa.int64())

    return of(raw(text))


def _bit_sums(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, the 64 x 64 counts of bits set together, and the counts of each byte's values."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, cells = np.zeros((BITS, BITS), np.int64), np.zeros((BITS // CELL, 256), np.int64)
        for batch in batches:
            octets = batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            for i in range(BITS // CELL):
                cells[i] += np.bincount(octets[:, i], minlength=256)
        out = np.concatenate((both.ravel(), cells.ravel()))
        yield pa.record_batch([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["cell", "n"])

    rows = prints.mapInArrow(sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + BITS // CELL * 256, np.int64)
    for r in rows:  # a fixed number of cells
        out[r["cell"]] = r["n"]
    both, cells = out[: BITS * BITS].reshape(BITS, BITS), out[BITS * BITS :].reshape(-1, 256)
    return int(cells[0].sum()), both, cells


def bit_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of about equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - i)
        group = [max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: tie[b, group].sum()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def choose_parts(n: int, radius: int) -> int:
    """The number of groups with the lowest cost for ``n`` evenly spread fingerprints."""

    def cost(m: int) -> float:
        width, total = BITS // m, 0.0
        for i in range(m):
            t = (radius - m + 1) // m + (i < (radius - m + 1) % m)
            probes = sum(_choose(width, j) for j in range(t + 1))
            total += probes * (PROBE_COST + n / 2.0**width)
        return total

    return min(range(2, 9), key=cost)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def estimates(octets: np.ndarray, group: list[int], n: int, cells: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint and t in 0..radius: how many fingerprints are within t bits in ``group``.

    The bits of a group that lie in the same byte are looked up together, with
    the counts of all fingerprints; bytes are taken as independent.
    """
    found = np.zeros((len(octets), radius + 1))
    found[:, 0] = 1.0  # shares at distance 0, 1, ...
    for i in range(BITS // CELL):
        mask = sum(1 << (b % CELL) for b in group if b // CELL == i)
        if not mask:
            continue
        far = ONES[(np.arange(256)[:, None] ^ np.arange(256)) & mask]
        at = np.stack([(far == t) @ (cells[i] / max(n, 1)) for t in range(radius + 1)], axis=1)[octets[:, i]]
        found = np.stack([(found[:, : t + 1] * at[:, t::-1]).sum(1) for t in range(radius + 1)], axis=1)
    return found.cumsum(1) * n


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (rows x groups) that add up to ``total`` at the lowest cost.

    ``costs[:, i, t + 1]`` is the cost of threshold t in group i; t = -1 is free.
    """
    rows, parts, steps = costs.shape
    span = total + parts  # the sum of t + 1
    best = np.full((rows, span + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for i in range(parts):
        options = np.full((rows, span + 1, steps), np.inf)
        for t in range(min(steps, span + 1)):
            options[:, t:, t] = best[:, : span + 1 - t] + costs[:, i, t][:, None]
        picks.append(options.argmin(2))
        best = options.min(2)
    out, left = np.zeros((rows, parts), np.int64), np.full(rows, span)
    for i in reversed(range(parts)):
        out[:, i] = picks[i][np.arange(rows), left]
        left = left - out[:, i]
    return out - 1


def _values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.uint64) @ (np.uint64(1) << np.arange(len(group), dtype=np.uint64))


def _probes(prints: DataFrame, groups: list[list[int]], n: int, cells: np.ndarray, radius: int) -> DataFrame:
    """(part, value, fp, own): each fingerprint under its own values, and under those that it probes."""
    flips = [[sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(len(g)), k)] for g in groups]
    reach = [[sum(_choose(len(g), j) for j in range(t + 1)) for t in range(radius + 1)] for g in groups]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().astype("<i8")
            octets = fps.view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little")
            costs = np.zeros((len(fps), len(groups), radius + 2))
            for i, g in enumerate(groups):
                costs[:, i, 1:] = estimates(octets, g, n, cells, radius) + PROBE_COST * np.array(reach[i])
            limits = allocate(costs, radius - len(groups) + 1)
            for i, g in enumerate(groups):
                own = _values(bits, g)
                yield _rows(i, own, fps, True)
                for t in range(radius + 1):
                    some = limits[:, i] == t
                    if some.any():
                        near = own[some][:, None] ^ np.array(flips[i][: reach[i][t]], np.uint64)
                        yield _rows(i, near.ravel(), np.repeat(fps[some], reach[i][t]), False)

    def _rows(part: int, value: np.ndarray, fp: np.ndarray, own: bool) -> pa.RecordBatch:
        k = len(fp)
        return pa.record_batch(
            [np.full(k, part, np.int32), value.astype(np.int64), fp.astype(np.int64), np.full(k, own)],
            ["part", "value", "fp", "own"],
        )

    return prints.mapInArrow(probes, "part int, value long, fp long, own boolean")


def _crowd_links(members: DataFrame, radius: int) -> DataFrame:
    """Stars (u, v) that connect the fingerprints within ``radius``, without forming pairs.

    Each writes the fingerprints within ceil(radius / 2) bits of its own, and is
    near to those within floor(radius / 2).  Who writes a value is within the
    radius of everyone who is near to it.
    """
    far, near = (radius + 1) // 2, radius // 2
    masks = [sum(1 << b for b in c) for k in range(far + 1) for c in combinations(range(BITS), k)]
    masks = np.array(masks, np.uint64).view(np.int64)
    close = np.array([bin(int(m) & (2**64 - 1)).count("1") <= near for m in masks])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64)
            for at in range(0, len(fps), 1024):
                some = fps[at : at + 1024]
                yield pa.record_batch(
                    [(some[:, None] ^ masks).ravel(), np.repeat(some, len(masks)), np.tile(close, len(some))],
                    ["value", "fp", "near"],
                )

    written = members.mapInArrow(write, "value long, fp long, near boolean")
    hubs = written.groupBy("value").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("v"), F.count(F.lit(1)).alias("n")
    )
    return (
        written.select("value", F.col("fp").alias("u"))
        .join(hubs.where("n > 1 and v is not null"), "value")
        .where("u <> v")
        .select("u", "v")
    )


def links(prints: DataFrame, radius: int = 2, parts: int | None = None, crowd: int = 64) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints ``prints(fp)`` within ``radius`` bits.

    Every pair within the radius is connected: by a link of its own, or through
    a hub that is within the radius of both.
    """
    n, both, cells = _bit_sums(prints)
    groups = bit_groups(n, both, parts or choose_parts(n, radius))
    rows = cut(_probes(prints, groups, n, cells, radius))
    sizes = rows.groupBy("part", "value").agg(F.count_if("own").alias("members"), F.count(F.lit(1)).alias("n"))
    crowded = sizes.where((F.col("members") > crowd) & (F.col("n") > F.col("members"))).select("part", "value")
    calm = rows.join(crowded, ["part", "value"], "left_anti")
    pairs = (
        calm.where("own")
        .select("part", "value", F.col("fp").alias("u"))
        .join(calm.where("not own").select("part", "value", F.col("fp").alias("v")), ["part", "value"])
        .where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
        .select("u", "v")
    )
    members = rows.join(crowded, ["part", "value"], "left_semi").select("fp").distinct()
    return pairs.unionByName(_crowd_links(members, radius)).distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id) of every row; the component is the smallest id that is reachable."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, width).alias("fp")))
    return label(prints, radius)


def label(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for rows (id, fp)."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    names = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def hex_print(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex_print(F.col("fp")).alias("fingerprint"), "component_id")
