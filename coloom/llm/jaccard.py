"""Near copies: all texts whose word shingles have a Jaccard similarity of 4/5 or more.

Nothing is estimated; the links are those that a comparison of all pairs finds.  Most are
found by SimHash, and the rest, which fingerprints cannot promise, by a join on shingles.

1. A text is the set of its hashed shingles of ``width`` words, A-Z lower-cased; a
   shorter text is one shingle.  Equal sets are one node.  The shingles' SimHash is the
   fingerprint of a set; fingerprints within ``radius`` bits are found as in ``simhash`` and
   their sets verified as in 5.
2. For the join, shingles have one order for all texts: those met often in a quarter of the texts come
   last, by how often; the rest stand by hash.  The share is the same at every size of the
   corpus, so how many texts a shingle of the rest is in does not grow.  What the sample says
   only changes the cost.
3. Let two sets of n <= m shingles have similarity 4/5, that is share 4 (n + m) / 9 of them.
   Their first shared shingle, at places i and j of the order, has all the others behind it:
   min(n - i, m - j) + 1 >= 4 (n + m) / 9 (places from 1).  So only the first
   n - ceil(4 n / 5) + 1 shingles of a set are posted, and a row for two sets is made only
   where their places on a list allow it.  Texts that share a passage, which stands late in
   the order, make none.
4. Only components are asked for, so only sets of different components, those of the links so
   far, are compared.  In ``rounds`` rounds each set is compared with one pivot per list, first
   with the set that most others share their first shingles with (the text that a group was
   copied from), then with sets by hash.  What is left is compared with one another: a large
   group of copies costs what its members cost.
5. Each candidate is verified on the whole sets, which are made anew from the texts of the
   candidates alone.

Lists are cut down by aggregates that Spark begins before the shuffle, then joined back.

Sets, and shingles inside them, are told by 64 bits, shingles on lists by 40.  Null texts and texts without words are equal and one
group.  Repeated rows are equal sets; ids that are repeated stand for all their rows.  Very
long texts are taken whole; a task holds one batch of sets.  Ties between pivots are settled
by hash and change no result.  An empty table gives no rows.  Columns other than id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from coloom.llm import simhash
from coloom.llm.common import raw
from coloom.llm.lm import mix
from coloom.operators.components import components
from coloom.session import cut, free_shuffles

#: One text in ``SHARE`` is looked at for common shingles; met ``OFTEN`` there they are common; ``MOST`` are kept, the most frequent.
SHARE, OFTEN, MOST = 4, 4, 1 << 20
#: The lower bits of a posted shingle, which hold its place.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1
#: Bits of the map that tells most rows apart from candidates before a join does so exactly.
MAP = 1 << 24
#: Links of two longs, 2 MB, whose components one task finds without exchanges.
FEW = 1 << 17


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The different hashed shingles of a text, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(1))
    return np.unique(out)


def prefix(items: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set: rare ones before common ones."""
    n = len(items)
    first = n - (4 * n + 4) // 5 + 1 if n else 0
    known, counts = common
    if not len(known):
        return items[:first]
    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
    met = np.where(known[at] == items, counts[at], 0)
    return items[np.lexsort((items, met))[:first]]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def shingle_column(text_col: str, width: int) -> Column:
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return _lists([shingles(t.as_py(), width) for t in texts])

    return of(raw(text_col))


def _common(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a share of the texts repeats, sorted, and how many texts of it have them."""
    some = docs.where(F.pmod(F.xxhash64(raw(text_col), F.lit(5)), F.lit(SHARE)) == 0)
    met = some.select(F.explode(shingle_column(text_col, width)).alias("s")).groupBy("s").count().where(F.col("count") >= OFTEN)
    met = cut(met)
    size = F.floor(F.log2("count")).cast("int")
    least, n = 64, 0
    for r in sorted(met.groupBy(size.alias("size")).count().collect(), reverse=True):
        if (n := n + r["count"]) > MOST:
            break
        least = r["size"]
    found = met.where(size >= least).toArrow()
    known = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], found.column("count").to_numpy()[order]


def _nodes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, node, fp) of each row."""

    @F.arrow_udf("struct<node: long, fp: long>")
    def of(texts: pa.Array) -> pa.Array:
        node, fp = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):  # one whole set at a time
            s = shingles(t.as_py(), width)
            node[i], fp[i] = xxh64_intdigest(s.tobytes()), simhash.fingerprint_of(s)
        return pa.StructArray.from_arrays([pa.array(node.view(np.int64)), pa.array(fp)], ["node", "fp"])

    return cut(docs.select(F.col(id_col).alias("id"), of(raw(text_col)).alias("s")).select("id", "s.*"))


def packed(first: np.ndarray) -> np.ndarray:
    """The shingles of a prefix by their upper 40 bits, with their places, from 1, in the 24 bits below.

    Shingles that are told by fewer bits make candidates, no links, and a place too large for its
    bits is given as an earlier one, where more pairs fit.
    """
    places = np.minimum(np.arange(1, len(first) + 1, dtype=np.uint64), np.uint64(PLACES))
    return first & ~np.uint64(PLACES) | places


def _posts(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, n, i, shingle) of the prefix of each row's set, dealt by shingle.

    Sets are made anew, as prefixes stored with the rows would stay on disk to the end, and
    what is shuffled is a long for a shingle and its place.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, width))
    free_shuffles(docs.sparkSession)

    @F.arrow_udf("struct<node: long, n: int, posts: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        node, n, posts = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32), []
        for i, t in enumerate(texts):
            s = shingles(t.as_py(), width)
            node[i], n[i] = xxh64_intdigest(s.tobytes()), len(s)
            posts.append(packed(prefix(s, sent.value)))
        return pa.StructArray.from_arrays([pa.array(node.view(np.int64)), pa.array(n), _lists(posts)], ["node", "n", "posts"])

    each = docs.select(of(raw(text_col)).alias("s")).select("s.node", "s.n", F.explode("s.posts").alias("post"))
    shingle = F.shiftrightunsigned("post", PLACE_BITS)
    place = F.col("post").bitwiseAND(F.lit(PLACES)).cast("int")
    return each.repartition(shingle).select("node", "n", place.alias("i"), shingle.alias("shingle"))


#: Whether sets of n and m shingles, whose first shared one is at i and j, can have the similarity.
FIT = "9 * (least(n - i, m - j) + 1) >= 4 * (n + m)"


def similar(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): pairs that connect all ``nodes(node, fp)`` whose fingerprints are within ``radius`` bits."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("v")))
    same = nodes.join(prints, "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    near = simhash.links(prints.select("fp"), radius).withColumnsRenamed({"u": "a", "v": "b"})
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("v").alias("u")), "a").join(prints.withColumnRenamed("fp", "b"), "b")
    return same.unionByName(near.select("u", "v"))


def _candidates(met: DataFrame) -> DataFrame:
    """(u, v), smaller first, of rows (u, v)."""
    return cut(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def _among(ids: DataFrame, col: str) -> Column:
    """Whether the id in ``col`` may be among ``ids``: always for those that are, seldom for others."""
    place = (F.xxhash64(ids.columns[0]).bitwiseAND(F.lit(MAP - 1))).alias("h")
    words = ids.select(place).select(F.expr("h div 64").alias("w"), F.expr("shiftleft(1L, int(h % 64))").alias("b"))
    on = np.zeros(MAP // 64, np.int64)
    # At most MAP / 64 rows, 4 MB, whatever the number of ids.
    met = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    on[met.column("w").to_numpy()] = met.column("b").to_numpy()
    sent = ids.sparkSession.sparkContext.broadcast(on)

    @F.arrow_udf("boolean")
    def of(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False) & (MAP - 1)
        return pa.array((sent.value[h >> 6] >> (h & 63)) & 1 == 1)

    return of(F.xxhash64(col))


def _sets(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """(node, items): the whole sets of the nodes of ``pairs(u, v)``."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    ends = cut(ends.join(firsts, "node").select("first", "node"))
    # A node has one ``first``: with it in the key, texts that are dealt by it are not dealt again.
    texts = docs.where(_among(ends, "first")).join(ends, "first").dropDuplicates(["first", "node"])
    return cut(texts.select("node", shingle_column("text", width).alias("items")))


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """The (u, v) whose sets have the similarity; ``docs(first, text)``, ``firsts(node, first)``.

    The files of the candidates, of the texts and of the sets are not on disk together.
    """
    free_shuffles(docs.sparkSession)
    sets = _sets(pairs, docs, firsts, width)
    free_shuffles(docs.sparkSession)
    a = sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return cut(pairs.join(a, "u").join(b, "v").where(9 * both >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))


def _live(lists: DataFrame, by: str) -> DataFrame:
    """The rows of the lists that hold two different ``by``; the lists are shuffled once."""
    whole = Window.partitionBy("shingle")
    ends = lists.withColumns({"low": F.min(by).over(whole), "high": F.max(by).over(whole)})
    return ends.where("low <> high").drop("low", "high")


def _central(shared: DataFrame) -> DataFrame:
    """``shared`` with ``c``: how many sets there are on a set's lists."""
    counts = shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"))
    score = shared.join(counts, "shingle").groupBy("node").agg((F.sum("k") / F.max("n")).alias("c"))
    return shared.join(score, "node")


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared`` with ``root``, the component of a set, on the lists that hold two of them."""
    named = shared.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    return cut(_live(named, "root"))


def _pivot_pairs(shared: DataFrame, roots: DataFrame, step: int) -> DataFrame:
    """Candidates (u, v) of the sets and one pivot on each list."""
    live = _apart(shared, roots)
    first = F.col("c") if step == 0 else F.lit(0)
    pivots = live.groupBy("shingle").agg(F.max(F.struct(first.alias("c"), F.xxhash64("node", F.lit(step)).alias("h"), "node", "n", "i", "root")).alias("p"))
    met = live.select("shingle", F.col("node").alias("u"), "n", "i", "root").join(
        pivots.select("shingle", F.col("p.node").alias("v"), F.col("p.n").alias("m"), F.col("p.i").alias("j"), F.col("p.root").alias("to")), "shingle"
    )
    return _candidates(met.where(F.col("root") != F.col("to")).where(FIT))


def _other_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates (u, v) of all sets on a list."""
    live = _apart(shared, roots)
    mine = live.select("shingle", F.col("node").alias("u"), "n", "i", "root")
    other = live.select("shingle", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("to"))
    # The smaller set of a pair meets the larger; of equal ones, the smaller node.
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("u") < F.col("v")))
    return _candidates(mine.join(other, "shingle").where(once & (F.col("root") != F.col("to"))).where(FIT))


def near_groups(docs: DataFrame, id_col: str, text_col: str, width: int = 5, rounds: int = 1, radius: int = 2) -> DataFrame:
    """(id, component_id) of every row; the component is the smallest id that is reachable.  No id is null."""
    rows = _nodes(docs, id_col, text_col, width)
    firsts = cut(rows.groupBy("node").agg(F.min("id").alias("first"), F.first("fp").alias("fp")))
    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text"))
    nodes, firsts = firsts.select("node", "fp"), firsts.select("node", "first")
    links = _verified(_candidates(similar(nodes, radius)), texts, firsts, width)
    roots = components(links, FEW)

    # Equal sets post alike; their rows are one from here.
    live = cut(_live(_posts(docs, text_col, width), "node").distinct())
    free_shuffles(docs.sparkSession)
    shared = cut(_central(live))
    del live  # files go with the last one that holds them
    free_shuffles(docs.sparkSession)
    for step in range(rounds):
        found = _verified(_pivot_pairs(shared, roots, step), texts, firsts, width)
        links = links.unionByName(found)
        roots = components(links, FEW)
        free_shuffles(docs.sparkSession)
    pairs = _other_pairs(shared, roots)
    del shared  # before the sets are made
    found = _verified(pairs, texts, firsts, width)
    free_shuffles(docs.sparkSession)
    if not found.isEmpty():
        roots = components(links.unionByName(found), FEW)
    nodes = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    names = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(names, "root").select("node", "component_id")
    return rows.select("id", "node").join(named, "node").select("id", "component_id")
