"""Benchmark decontamination with a distributed positional inverted index.

1. ``build_index`` turns the documents into shards.  A shard holds, for every
   benchmark term, the ascending list of its positions in the shard's texts.  The
   shards stay where the documents are read; they are stored in the checkpoint
   folder, so searching never reads the texts again.
2. The shards' list sizes give the corpus frequency of each term.
3. ``search`` looks for windows of ``width`` consecutive item words.  A window
   starts from its rarest term; the other lists, rarest first, are shifted by
   their offset and intersected.  What is left are exact phrases.  An item of
   fewer words is one window.  Items whose rarest terms stand within ``slop``
   words of each other, in any order, are reported as proximity matches.

The benchmark is read in blocks of about ``block_words`` words; a block, its
vocabulary and its counts are what the driver holds and broadcasts.  Every block
is searched in all shards.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z lower-cased.  Null texts have no words.  Items without words or without an id
take no part.  Rows with the same item id are one item with several texts.  Every
document row gives one row, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import content_key, raw, small_batches, table
from coloom.session import cut

#: Each byte as it counts in a word: A-Z lower-cased, what separates words as a space.
AS_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Bytes of text in one shard, about.
SHARD = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(AS_WORD).split()


def build_index(docs: DataFrame, keys: list[Column], text_col: str, terms: dict[bytes, int]) -> DataFrame:
    """Shards (keys, ends, terms, sizes, lists) of the positions of ``terms``.

    keys and ends: the documents' keys and the position after each one's last
    word.  terms, sizes: the terms that occur and how often.  lists: their
    positions, one list after the other, as packed differences.
    """
    known = docs.sparkSession.sparkContext.broadcast(terms)
    whole = docs.select(F.struct(*keys).alias("key"), raw(text_col).alias("text"))
    kind = whole.schema["key"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, pack = known.value.get, zstandard.ZstdCompressor(level=1)
        for batch in small_batches(batches, SHARD):
            found, sizes = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                sizes.append(len(words))
            ids = np.concatenate(found)
            at = np.flatnonzero(ids >= 0)
            at = at[np.argsort(ids[at], kind="stable")]
            present, counts = np.unique(ids[at], return_counts=True)
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.record_batch(
                [
                    pa.ListArray.from_arrays(one, batch.column("key")),
                    pa.array([np.cumsum(sizes, dtype=np.int64)], pa.list_(pa.int64())),
                    pa.array([present], pa.list_(pa.int32())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([pack.compress(np.diff(at, prepend=0).astype("<i4").tobytes())], pa.binary()),
                ],
                ["keys", "ends", "terms", "sizes", "lists"],
            )

    schema = f"keys array<{kind}>, ends array<long>, terms array<int>, sizes array<long>, lists binary"
    return cut(whole.mapInArrow(index, schema))


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each term occurs in the corpus."""
    each = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t"))
    counts = np.zeros(n_terms, np.int64)
    for r in each.groupBy("t.terms").agg(F.sum("t.sizes").alias("n")).collect():  # a block's terms at most
        counts[r["terms"]] = r["n"]
    return counts


def phrases(items: list[list[int]], counts: np.ndarray, width: int) -> dict[int, list[tuple]]:
    """Rarest term -> its windows (item, length, [(term, offset), .. rarest first])."""
    out: dict[int, list[tuple]] = {}
    for item, terms in enumerate(items):
        n = min(width, len(terms))
        for i in range(len(terms) - n + 1):
            ranked = sorted(((t, o) for o, t in enumerate(terms[i : i + n])), key=lambda x: (counts[x[0]], x))
            out.setdefault(ranked[0][0], []).append((item, n, ranked))
    return out


def near_terms(items: list[list[int]], counts: np.ndarray, rarest: int) -> dict[int, list[tuple]]:
    """Rarest term -> (item, the next rarest different terms), for items with that many."""
    out: dict[int, list[tuple]] = {}
    for item, terms in enumerate(items):
        ranked = sorted(set(terms), key=lambda t: (counts[t], t))[:rarest]
        if len(ranked) == rarest:
            out.setdefault(ranked[0], []).append((item, ranked[1:]))
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of ``a`` that are in the ascending ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


def _near(lead: np.ndarray, others: list[np.ndarray], slop: int, doc_of: Callable) -> np.ndarray:
    """The positions of ``lead`` with one of each other list at most ``slop`` away in the same text."""
    for other in others:
        at = np.searchsorted(other, lead)
        left, right = other[np.maximum(at - 1, 0)], other[np.minimum(at, len(other) - 1)]
        ok = [(np.abs(x - lead) <= slop) & (doc_of(x) == doc_of(lead)) for x in (left, right)]
        lead = lead[ok[0] | ok[1]]
    return lead


def search(
    index: DataFrame, names: list[str], items: list[list[int]], counts: np.ndarray, width: int, rarest: int, slop: int
) -> DataFrame:
    """(key, n_words, spans, items, near): the exact and the proximity matches of each document."""
    plan = index.sparkSession.sparkContext.broadcast(
        (names, phrases(items, counts, width), near_terms(items, counts, rarest))
    )
    kind = index.schema["keys"].dataType.elementType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows, close = plan.value
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                keys = part.column("keys").flatten()
                ends = part.column("ends").flatten().to_numpy()
                sizes = part.column("sizes").flatten().to_numpy()
                packed = unpack.decompress(part.column("lists")[0].as_py())
                at = np.cumsum(np.frombuffer(packed, "<i4"), dtype=np.int64)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                terms = part.column("terms").flatten().to_pylist()
                lists = {t: at[cuts[i] : cuts[i + 1]] for i, t in enumerate(terms)}

                def doc_of(p: np.ndarray, ends=ends) -> np.ndarray:
                    return np.searchsorted(ends, p, "right")

                hits = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
                exact, near = {}, {}
                for lead in terms:
                    for item, n, ranked in windows.get(lead, ()):
                        here = lists[lead] - ranked[0][1]
                        for term, offset in ranked[1:]:
                            if not len(here) or term not in lists:
                                here = here[:0]
                                break
                            here = _meet(here + offset, lists[term]) - offset
                        here = here[here >= 0]
                        here = here[doc_of(here) == doc_of(here + n - 1)]
                        if len(here):
                            hits[here] += 1
                            hits[here + n] -= 1
                            for d in np.unique(doc_of(here)).tolist():
                                exact.setdefault(d, set()).add(names[item])
                    for item, others in close.get(lead, ()):
                        if all(t in lists for t in others):
                            here = _near(lists[lead], [lists[t] for t in others], slop, doc_of)
                            for d in np.unique(doc_of(here)).tolist():
                                near.setdefault(d, set()).add(names[item])
                yield _found(keys, ends, hits, exact, near)

    def _found(keys, ends, hits, exact, near) -> pa.RecordBatch:
        docs = len(ends)
        starts = np.concatenate(([0], ends[:-1])) if docs else ends
        covered = (hits.cumsum() > 0).astype(np.int8)[: int(ends[-1])] if docs else hits[:0]
        edges = np.diff(covered, prepend=0, append=0)
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        spans: list[list[dict]] = [[] for _ in range(docs)]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            d = int(np.searchsorted(ends, x, "right"))
            while x < y:  # a run may go on in the next text
                stop = min(y, int(ends[d]))
                if stop > x:
                    spans[d].append({"a": x - int(starts[d]), "b": stop - int(starts[d])})
                x, d = stop, d + 1
        return pa.record_batch(
            [
                keys,
                pa.array(ends - starts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                pa.array([sorted(exact.get(d, ())) for d in range(docs)], pa.list_(pa.string())),
                pa.array([sorted(near.get(d, ())) for d in range(docs)], pa.list_(pa.string())),
            ],
            ["key", "n_words", "spans", "items", "near"],
        )

    schema = f"key {kind}, n_words long, spans array<struct<a: long, b: long>>, items array<string>, near array<string>"
    return index.mapInArrow(look, schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> tuple[int, Iterator[list]]:
    """The number of blocks, and the items [(id, words)] of each; a block fits the driver."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), raw(text_col).alias("text")
    )
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + size // (4 * block_words)

    def read() -> Iterator[list]:
        for i in range(n):
            some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).distinct()
            yield [(r["item"], w) for r in some.toLocalIterator() if (w := words_of(bytes(r["text"])))]

    return n, read()


def matches(
    docs: DataFrame,
    keys: list[Column],
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    rarest: int = 3,
    slop: int = 20,
    block_words: int = 2_000_000,
) -> DataFrame:
    """(key, n_words, spans, items, near) of each document.

    spans: the runs a..b of words inside an occurrence of a window, b excluded.
    items, near: the ids, as strings, with an exact and with a proximity match.
    """
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    # Rows that meet again after several blocks are told apart by their text, and equal rows by a number.
    own = [*keys, *(k.alias(f"content_{i}") for i, k in enumerate(content_key(raw(text_col))))] if n > 1 else keys
    parts = []
    for block in blocks:
        terms = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in block for w in words))}
        index = build_index(docs, own, text_col, terms)
        names, items = [name for name, _ in block], [[terms[w] for w in words] for _, words in block]
        parts.append(search(index, names, items, frequencies(index, len(terms)), width, rarest, slop))
    if n == 1:
        return parts[0]
    same = Window.partitionBy("key").orderBy("n_words")
    every = reduce(DataFrame.unionByName, [p.withColumn("copy", F.row_number().over(same)) for p in parts])
    return (
        every.groupBy("key", "copy", "n_words")
        .agg(
            _union(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        )
        .drop("copy")
    )


def _union(spans: Column) -> Column:
    """The spans without overlaps."""

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            merged: list[dict] = []
            for s in sorted(row, key=lambda s: (s["a"], s["b"])):
                if merged and s["a"] <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], s["b"])
                else:
                    merged.append(s)
            out.append(merged)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return of(spans)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), [F.col("doc_id")], table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "key.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
      FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark, low),
w AS (SELECT DISTINCT item_id, least(10, len(words)) AS n,
             array_to_string(words[k:k + least(10, len(words)) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM i WHERE len(words) > 0)),
g AS (SELECT rid, k, n, array_to_string(words[k:k + n - 1], ' ') AS win
      FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS k
            FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
m AS (SELECT rid, k, g.n, item_id FROM g JOIN w USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
