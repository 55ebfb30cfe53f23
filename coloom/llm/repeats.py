"""Repeated passages found with prefix-partitioned suffix trees.

A window is ``depth`` consecutive words of one document.  Words covered by a
window that also starts elsewhere are marked.  The windows are the suffixes of
the texts, cut at the depth that matters; a window repeats exactly when its leaf
hangs below an internal node of at least that depth.

1. Equal texts are one text with a count.  All windows of a text with two or more
   copies repeat, so the copies need no tree.
2. Each window owns the ``gram`` words of lowest hash inside it.  Equal windows
   own equal grams at equal offsets, so suffixes are partitioned by that prefix
   read from the gram, and a gram that occurs once leads to no internal node.
   Only grams met twice or more go on; the others never leave the counting step.
3. A prefix with up to ``group`` places is one memory-sized group, and small
   groups share a batch.  Each place brings the words that its windows span.  A
   batch sorts its suffixes by doubling (1, 2, 4, .. words), which is the order of
   the leaves; classes of two or more leaves at the full depth are the deep nodes.
4. A prefix with more places is lengthened to the full depth (128 bits that stand
   for the window), where the node needs only its count.

Nothing is gathered per prefix beyond ``group`` places, and nothing per document
beyond that document.

A null text has no words.  Texts shorter than the depth keep everything.  Every
row gives a row; repeated rows are copies of each other.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from coloom.llm.common import content_key, raw, table

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> list[np.uint64]:
    return [np.uint64(pow(base, i, 1 << 64)) for i in range(n)]


def _rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i, p in enumerate(_powers(base, width)):
        out += h[i : i + n] * p
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def owned(words: list[bytes], depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; for each owning gram in order its hash, and its first and last window."""
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    grams = _rolling(h, gram, ODD[0])
    at = _lowest(grams, depth - gram + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return h, grams[at[first]].view(np.int64), first, last


def _lowest(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the lowest of every ``width`` consecutive grams stands.

    The lowest of 1, 2, 4, .. grams are combined.  Equal windows get equal offsets.
    """
    least, at, have = grams, np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[: len(least) - step]
        at = np.where(later, at[step:], at[: len(at) - step])
        least = np.where(later, least[step:], least[: len(least) - step])
        have += step
    return at


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("k1").to_numpy(), batch.column("k2").to_numpy()


def _grams(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """(h, k1, k2, n): the owning grams of each text and how often they own."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                both = ()
                if len(words) >= depth:
                    both = np.unique(owned(words, depth, gram)[1], return_counts=True)
                    out.append(both)
                sizes.append(len(both[0]) if both else 0)
            if out:
                k1, k2 = (np.repeat(k, sizes) for k in _keys(batch))
                h, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([h, k1, k2, n.astype(np.int32)], ["h", "k1", "k2", "n"])

    return texts.mapInArrow(find, "h long, k1 long, k2 long, n int")


def _places(found: DataFrame, depth: int, gram: int) -> DataFrame:
    """(h, k1, k2, start, body): the words that the windows of a repeated gram span."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], [], []]
            wanted = batch.column("calm").to_pylist()
            for text, k1, k2, calm in zip(batch.column("text").to_pylist(), *map(list, _keys(batch)), wanted, strict=True):
                words = text.split()
                _, h, first, last = owned(words, depth, gram)
                for i in np.flatnonzero(np.isin(h, np.array(calm, np.int64))):
                    body = b" ".join(words[first[i] : last[i] + depth])
                    for column, value in zip(rows, (h[i], k1, k2, first[i], body), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["h", "k1", "k2", "start", "body"]
            )

    some = found.where(F.size("calm") > 0).select("text", "k1", "k2", "copies", "calm")
    return some.mapInArrow(cut_out, "h long, k1 long, k2 long, start long, body binary")


def deep_leaves(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all words of the bodies: whether a leaf below a deep node starts there; the body's first word.

    Suffixes are ranked by doubling: equal ranks at width w mean w equal words.
    """
    ids: dict[bytes, int] = {}
    lists = [b.split() for b in bodies]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    n, width = len(rank), 1
    while width < depth:
        step = min(width, depth - width)
        rank = np.unique((rank[: len(rank) - step] << 32) | rank[step:], return_inverse=True)[1]
        width += step
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(n) - begins[owner] <= sizes[owner] - depth
    leaf = np.zeros(n, bool)
    starts = np.flatnonzero(inside)
    leaf[starts] = (np.bincount(rank[starts], minlength=1) > 1)[rank[starts]]
    return leaf, owner


def _subtrees(places: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, a, b): runs a..b of repeated windows, from trees over whole prefix groups."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            edge = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if edge or (rest and rest[-1].column("h")[-1].as_py() != h[0]):
                yield runs(rest + [batch.slice(0, edge)])
                rest = []
            rest.append(batch.slice(edge))
        if rest:
            yield runs(rest)

    def runs(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(group)
        leaf, owner = deep_leaves(rows.column("body").to_pylist(), depth)
        edges = np.diff(leaf.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        at = owner[a]
        begins = np.searchsorted(owner, np.arange(rows.num_rows))
        k1, k2, start = (rows.column(c).to_numpy()[at] for c in ("k1", "k2", "start"))
        shift = start - begins[at]
        return pa.record_batch([k1, k2, a + shift, b + shift], ["k1", "k2", "a", "b"])

    dealt = places.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(grow, "k1 long, k2 long, a long, b long")


def _full_prefixes(found: DataFrame, depth: int, gram: int) -> DataFrame:
    """(k1, k2, a, b) of the repeated windows below prefixes with too many places for one group."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("crowded").to_pylist()
            for text, k1, k2, crowded in zip(batch.column("text").to_pylist(), *_keys(batch), wanted, strict=True):
                words = text.split()
                h, grams, first, last = owned(words, depth, gram)
                mine = np.zeros(len(words) - depth + 2, np.int64)
                some = np.isin(grams, np.array(crowded, np.int64))
                mine[first[some]] += 1
                mine[last[some] + 1] -= 1
                start = np.flatnonzero(mine.cumsum()[:-1])
                w1, w2 = (_rolling(x, depth, p)[start].view(np.int64) for x, p in zip((h, h ^ (h >> np.uint64(31))), ODD, strict=True))
                n = len(start)
                yield pa.record_batch(
                    [w1, w2, np.full(n, k1), np.full(n, k2), start], ["w1", "w2", "k1", "k2", "start"]
                )

    some = found.where(F.size("crowded") > 0).select("text", "k1", "k2", "copies", "crowded")
    windows = some.mapInArrow(write, "w1 long, w2 long, k1 long, k2 long, start long")
    nodes = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return windows.join(nodes, ["w1", "w2"], "left_semi").select(
        "k1", "k2", F.col("start").alias("a"), F.col("start").alias("b")
    )


def repeats(
    docs: DataFrame, text_col: str = "text", depth: int = 35, gram: int = 5, group: int = 20_000
) -> DataFrame:
    """(k1, k2, text, copies, runs): each distinct text, as bytes, with its runs of repeated windows."""
    whole = docs.select(raw(text_col).alias("text"))
    texts = (
        whole.select(*content_key(F.col("text")), "text")
        .groupBy("k1", "k2")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    grams = _grams(texts, depth, gram)
    shared = grams.groupBy("h").agg(F.sum("n").alias("places")).where("places > 1")
    wanted = (
        grams.join(shared, "h")
        .groupBy("k1", "k2")
        .agg(
            F.collect_list(F.when(F.col("places") <= group, F.col("h"))).alias("calm"),
            F.collect_list(F.when(F.col("places") > group, F.col("h"))).alias("crowded"),
        )
    )
    found = texts.join(wanted, ["k1", "k2"])
    runs = _subtrees(_places(found, depth, gram), depth).unionByName(_full_prefixes(found, depth, gram))
    runs = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return texts.join(runs, ["k1", "k2"], "left")


def covered(n: int, copies: int, runs: list[dict] | None, depth: int) -> np.ndarray:
    """Which of ``n`` words a repeated window covers."""
    if n < depth:
        return np.zeros(n, bool)
    if copies > 1:
        return np.ones(n, bool)
    edges = np.zeros(n + 1, np.int64)
    for r in runs or ():
        edges[r["a"]] += 1
        edges[r["b"] + depth] -= 1
    return edges.cumsum()[:-1] > 0


def kept_column(depth: int = 35):
    """(text, copies, runs) -> struct(n_words, n_removed, kept): the words that stay, joined by one space."""

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: binary>")
    def of(texts: pa.Array, copies: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, c, r in zip(texts.to_pylist(), copies.to_pylist(), runs.to_pylist(), strict=True):
            words = text.split()
            gone = covered(len(words), c, r, depth)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
            out.append({"n_words": len(words), "n_removed": int(gone.sum()), "kept": kept})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]))

    return of("text", "copies", "runs")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = (
        repeats(docs)
        .select("k1", "k2", kept_column().alias("r"))
        .select("k1", "k2", "r.n_words", "r.n_removed", F.sha2("r.kept", 256).alias("kept_sha256"))
    )
    rows = docs.select("doc_id", *content_key(raw("text")))
    return rows.join(cleaned, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT rid, unnest(range(1, len(words) - 33)) AS i, words FROM d WHERE len(words) >= 35),
w AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS win FROM starts),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1),
each AS (SELECT rid, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM d),
marked AS (SELECT each.rid, j, word,
                  coalesce(max(i) OVER (PARTITION BY each.rid ORDER BY j) >= j - 34, FALSE) AS gone
           FROM each LEFT JOIN hits ON hits.rid = each.rid AND hits.i = each.j),
sums AS (SELECT rid, count(*) FILTER (gone) AS n_removed,
                string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (rid)
"""
