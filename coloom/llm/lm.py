"""N-gram language model in a log-frequency Bloom filter.

1. ``gather``: tasks count the hashed unigrams and bigrams of the training texts
   and write them, sorted and packed, by ranges of the hash; each range is merged
   by one group.  What is shuffled grows with the corpus, and so do the ranges.
2. Every merged range becomes a block of the filter.  A count c is stored as
   q = 1 + floor(log_b c): the n-gram is put in under each of the levels 1..q.
   A block has ``bits`` bits for each entry.
3. The blocks are broadcast.  A count is read back by probing level 1, 2, .. until
   one is absent; the mean of the counts of that level stands for it.
   P(w | h) = l * c(hw) / c(h) + (1 - l) * P(w), everything from the filter.

The unigrams of a corpus are few and go out in every round; bigram blocks and the
exact unigram counts of the base score go out in as many rounds as ``most_mb``
asks for.  A round adds the tokens and bigrams of its ranges, so the sums are the
same however many rounds there are.  Where the unigram filter exceeds a quarter of
the bound, its blocks go out in rounds of their own before the others, which write
the level of each token of each text.  Entries have the same bits at every size.

The base score takes the exact counts: the sum of log10((c + 0.1) / (N + 0.1 (V + 1))).

Tokens are words between white space, A-Z lower-cased, and one end per text.
Null and empty texts are the end alone.  Without training rows N and V are 0.
Every row gives a row; repeated rows count as often as they occur; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from coloom.llm.common import content_key, raw, small_batches, table
from coloom.llm.language import remainder
from coloom.session import cut

#: A word has no white space, so these are no words.
END, BEGIN = xxh64_intdigest(b" "), xxh64_intdigest(b"\t")
#: Tokens that a task counts before it writes.
FLUSH = 3 << 20
#: Bytes of text that are looked at together.
CHUNK = 3 << 20
PROBES = 5
LEVEL_BASE = 1.5
LEVELS = 80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of what stands before each, and the number of tokens of each text."""
    lists = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
    ends = np.cumsum(sizes) - 1
    h = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(h), bool)
    inner[ends] = False
    h[inner] = np.fromiter(map(xxh64_intdigest, chain.from_iterable(lists)), np.uint64, len(h) - len(ends))
    h[ends] = END
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[ends - sizes + 1] = BEGIN
    return h, before, sizes


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_means() -> np.ndarray:
    """The mean of the counts of each level; 0 for level 0."""
    out = [0.0]
    for q in range(1, LEVELS):
        low, high = np.ceil(LEVEL_BASE ** (q - 1) - 1e-9), np.ceil(LEVEL_BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


# Packing: sorted numbers as differences, byte by byte, compressed.
def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T.tobytes()), squeeze(counts.astype("<i8").tobytes())


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = zstandard.ZstdDecompressor()
    steps = np.frombuffer(flat.decompress(keys), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64), np.frombuffer(flat.decompress(counts), "<i8")


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def entries(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys under each of their levels."""
    q = level(counts)
    under = np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q)
    return at_level(np.repeat(keys, q), under + 1)


def at_level(keys: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return mix(keys + np.asarray(q).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def block(keys: np.ndarray, counts: np.ndarray, bits: float) -> bytes:
    """A Bloom filter of the entries, 8 bytes at least."""
    e = entries(keys, counts)
    size = max(64, int(len(e) * bits) // 8 * 8)
    on = np.zeros(size, bool)
    step = stride(e)
    for i in range(PROBES):
        on[((e + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def stride(e: np.ndarray) -> np.ndarray:
    """How far apart the probes of an entry are."""
    return mix(e) | np.uint64(1)


@dataclass
class Filter:
    """Blocks of a log-frequency Bloom filter for consecutive ranges of the hash."""

    shift: int
    first: int
    bits: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    means: np.ndarray = field(default_factory=level_means)

    @classmethod
    def of(cls, shift: int, first: int, sizes: list[int], rows: Iterable) -> Filter:
        """From rows (bucket, block) in any order; ``sizes`` has the bytes of each block, 0 where there is none."""
        held = np.maximum(np.array(sizes, np.int64), 8)
        starts = np.cumsum(held) - held
        bits = np.zeros(int(held.sum()), np.uint8)
        for r in rows:
            at = starts[r["bucket"] - first]
            bits[at : at + len(r["block"])] = np.frombuffer(r["block"], np.uint8)
        return cls(shift, first, bits, starts, (held * 8).astype(np.uint64))

    def covers(self, keys: np.ndarray) -> np.ndarray:
        at = ranges(keys, self.shift)
        return (at >= self.first) & (at < self.first + len(self.sizes))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The stored counts, 0 where level 1 is absent; for keys that the blocks cover."""
        return self.means[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The stored levels, 0 where level 1 is absent; for keys that the blocks cover."""
        at = ranges(keys, self.shift) - self.first
        starts, sizes = self.starts[at], self.sizes[at]
        q, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for step in range(1, LEVELS):
            e, some = at_level(keys[alive], step), np.arange(len(alive))
            far, size, start = stride(e), sizes[alive], starts[alive]
            for i in range(PROBES):
                where = ((e + np.uint64(i) * far) % size).astype(np.int64)
                on = self.bits[start + (where >> 3)] >> (where & 7).astype(np.uint8) & 1 == 1
                if not on.all():
                    e, far, size, start, some = e[on], far[on], size[on], start[on], some[on]
            alive = alive[some]
            if not len(alive):
                break
            q[alive] = step
        return q


def ranges(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> np.uint64(shift)).astype(np.int64)


def gather(docs: DataFrame, text_col: str, bits: float) -> tuple[DataFrame, int]:
    """(gram, bucket, keys, counts, n, total, entries, block) of each hash range, and the shift that gives the range.

    gram 1 keeps its exact counts; each has a block of the filter.
    """
    parts = docs.rdd.getNumPartitions()
    shift = 64 - min(20, max(6, (4 * parts - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in small_batches(batches, CHUNK):
            h, before, _ = tokens(batch.column("text").to_pylist())
            held.append((h, pairs(before, h)))
            if sum(len(x) for x, _ in held) >= FLUSH:
                yield written(held)
                held = []
        if held:
            yield written(held)

    def written(held: list[tuple]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for gram in (1, 2):
            keys, counts = np.unique(np.concatenate([x[gram - 1] for x in held]), return_counts=True)
            at = ranges(keys, shift)
            cuts = np.flatnonzero(np.diff(at)) + 1
            for k, c in zip(np.split(keys, cuts), np.split(counts, cuts), strict=True):
                rows.append((gram, int(k[0] >> np.uint64(shift)), *pack(k, c)))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["gram", "bucket", "keys", "counts"])

    def merged(rows: pa.Table) -> pa.Table:
        gram, bucket = rows.column("gram")[0].as_py(), rows.column("bucket")[0].as_py()
        parts = [unpack(k, c) for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
        keys, counts = merge([p[0] for p in parts], [p[1] for p in parts])
        exact = pack(keys, counts) if gram == 1 else (b"", b"")
        out = (gram, bucket, *exact, len(keys), int(counts.sum()), int(level(counts).sum()), block(keys, counts, bits))
        return pa.table([pa.array([v], t) for v, t in zip(out, MERGED.types, strict=True)], schema=MERGED)

    raws = docs.select(raw(text_col).alias("text"))
    written_rows = raws.mapInArrow(count, "gram int, bucket int, keys binary, counts binary")
    schema = "gram int, bucket int, keys binary, counts binary, n long, total long, entries long, block binary"
    return cut(written_rows.groupBy("gram", "bucket").applyInArrow(merged, schema)), shift


MERGED = pa.schema(
    [
        ("gram", pa.int32()),
        ("bucket", pa.int32()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
        ("n", pa.int64()),
        ("total", pa.int64()),
        ("entries", pa.int64()),
        ("block", pa.binary()),
    ]
)


def _rounds(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive buckets whose sizes add up to ``most`` bytes at most, one bucket at least."""
    out, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            out.append((first, i))
            first, total = i, 0
        total += size
    return [*out, (first, len(sizes))]


def score(
    docs: DataFrame,
    train: DataFrame,
    keys: list[Column],
    text_col: str = "text",
    weight: float = 0.3,
    bits: float = 10.0,
    most_mb: int = 128,
) -> tuple[DataFrame, int, int]:
    """((keys.., n_tokens, n_known, base_score, score) of each of ``docs``, N, V), learnt from ``train``."""
    spark = docs.sparkSession
    ledger, shift = gather(train, text_col, bits)
    buckets = 1 << (64 - shift)
    # One small row for each range.
    held = {(r["gram"], r["bucket"]): r for r in ledger.select("gram", "bucket", "n", "total", "entries", F.length("block").alias("size")).collect()}
    ones = [r for (gram, _), r in held.items() if gram == 1]
    total, distinct = (sum(r[c] for r in ones) for c in ("total", "n"))
    most = most_mb << 20

    def sized(gram: int, low: int, high: int, what: str) -> list[int]:
        return [held[gram, i][what] if (gram, i) in held else 0 for i in range(low, high)]

    single = ledger.where("gram = 1").select("bucket", "block")
    word_sizes = sized(1, 0, buckets, "size")
    looked = sum(word_sizes) > most // 4  # the unigrams get a quarter of the bound
    if looked:
        docs, keys, text_col = _look_up(docs, keys, text_col, single, shift, word_sizes, most * 3 // 4)
    else:
        words = spark.sparkContext.broadcast(Filter.of(shift, 0, word_sizes, single.toLocalIterator()))
    means = level_means()

    def add_up(exact, grams, texts: list[bytes], levels: np.ndarray | None) -> tuple[np.ndarray, ...]:
        h, before, sizes = tokens(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        uniq, back = np.unique(h, return_inverse=True)
        known, counts, low, high = exact
        at = np.minimum(np.searchsorted(known, uniq), max(len(known) - 1, 0))
        c = np.where(known[at] == uniq, counts[at], 0) if len(known) else np.zeros(len(uniq), np.int64)
        bucket = ranges(uniq, shift)
        mine = (bucket >= low) & (bucket < high)
        base = np.where(mine, np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), 0.0)[back]
        seen = words.value.counts(uniq)[back] if levels is None else means[levels]
        alone = (seen + 0.1) / (total + 0.1 * (distinct + 1))
        key = pairs(before, h)
        here = grams.covers(key)
        both = np.zeros(len(h))
        both[here] = grams.counts(key[here])
        first = before == np.uint64(BEGIN)
        left = np.empty(len(h))
        left[1:] = seen[:-1]
        left[first] = starts
        share = np.minimum(both, left) / np.maximum(left, 1)
        p = np.where(left > 0, weight * share + (1 - weight) * alone, alone)
        model = np.where(here, np.log10(np.minimum(p, 1.0)), 0.0)
        n = len(texts)
        return (
            sizes,
            np.bincount(owner, np.where(mine & (c > 0), 1, 0)[back], n).astype(np.int64),
            np.bincount(owner, base, n),
            np.bincount(owner, model, n),
        )

    starts = train.count()  # each text begins once
    kind = "struct<n_tokens: long, n_known: long, base_score: double, score: double>"
    names = ["n_tokens", "n_known", "base_score", "score"]

    def round_of(low: int, high: int) -> tuple[Column, Broadcast]:
        rows = ledger.where((F.col("bucket") >= low) & (F.col("bucket") < high))
        places = np.cumsum([0, *sized(1, low, high, "n")])
        known, counts = np.zeros(places[-1], np.uint64), np.zeros(places[-1], np.uint32 if total < 1 << 32 else np.uint64)
        for r in rows.where("gram = 1").select("bucket", "keys", "counts").toLocalIterator():
            at = slice(places[r["bucket"] - low], places[r["bucket"] - low + 1])
            known[at], counts[at] = unpack(bytes(r["keys"]), bytes(r["counts"]))
        grams = Filter.of(shift, low, sized(2, low, high, "size"), rows.where("gram = 2").select("bucket", "block").toLocalIterator())
        sent = spark.sparkContext.broadcast(((known, counts, low, high), grams))

        def summed(batch: pa.RecordBatch) -> pa.Array:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for some in small_batches(iter([batch]), CHUNK):
                levels = _unpacked(some.column(1).to_pylist()) if looked else None
                for column, value in zip(out, add_up(*sent.value, some.column(0).to_pylist(), levels), strict=True):
                    column.append(value)
            return pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else []) for c in out], names)

        @F.arrow_udf(kind)
        def of(texts: pa.Array) -> pa.Array:
            return summed(pa.record_batch([texts], ["text"]))

        @F.arrow_udf(kind)
        def of_both(texts: pa.Array, levels: pa.Array) -> pa.Array:
            return summed(pa.record_batch([texts, levels], ["text", "levels"]))

        return of_both(raw(text_col), F.col("levels")) if looked else of(raw(text_col)), sent

    sizes = [12 * n + size for n, size in zip(sized(1, 0, buckets, "n"), sized(2, 0, buckets, "size"), strict=True)]
    plan = _rounds(sizes, most * 3 // 4)
    if len(plan) == 1:
        return docs.select(*keys, round_of(*plan[0])[0].alias("s")).select(*_names(docs, keys), "s.*"), total, distinct
    text = raw(text_col)
    parts = []
    for low, high in plan:
        column, sent = round_of(low, high)
        each = docs.select(*content_key(text), column.alias("s"))
        parts.append(cut(each.groupBy("k1", "k2").agg(F.first("s").alias("s"))))
        sent.destroy()
    sums = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(
        F.max("s.n_tokens").alias("n_tokens"), *[F.sum(f"s.{n}").alias(n) for n in names[1:]]
    )
    own = _names(docs, keys)
    rows = docs.select(F.struct(*keys).alias("own"), *content_key(text))
    return rows.join(sums, ["k1", "k2"]).select(*[f"own.{n}" for n in own], *names), total, distinct


def _unpacked(rows: list[list[bytes]]) -> np.ndarray:
    """The levels of all tokens, one text after the other; of a token one round has the level, the others 0."""
    flat = zstandard.ZstdDecompressor()
    each = [np.sum([np.frombuffer(flat.decompress(r), np.uint8) for r in row], axis=0, dtype=np.uint8) for row in rows]
    return np.concatenate(each) if each else np.zeros(0, np.uint8)


def _look_up(
    docs: DataFrame, keys: list[Column], text_col: str, blocks: DataFrame, shift: int, sizes: list[int], most: int
) -> tuple[DataFrame, list[Column], str]:
    """(rows (own, text, levels), their keys, the name of the text): the levels of the tokens' unigrams, in rounds."""
    text = raw(text_col)
    parts = []
    for low, high in _rounds(sizes, most):
        rows = blocks.where((F.col("bucket") >= low) & (F.col("bucket") < high))
        sent = docs.sparkSession.sparkContext.broadcast(Filter.of(shift, low, sizes[low:high], rows.toLocalIterator()))

        @F.arrow_udf("binary")
        def of(texts: pa.Array) -> pa.Array:
            squeeze, out = zstandard.ZstdCompressor(level=1).compress, []
            for some in small_batches(iter([pa.record_batch([texts], ["text"])]), CHUNK):
                h, _, n = tokens(some.column(0).to_pylist())
                uniq, back = np.unique(h, return_inverse=True)
                here = sent.value.covers(uniq)
                found = np.zeros(len(uniq), np.uint8)
                found[here] = sent.value.levels(uniq[here])
                out += [squeeze(x.tobytes()) for x in np.split(found[back], np.cumsum(n)[:-1])]
            return pa.array(out, pa.binary())

        each = docs.select(*content_key(text), of(text).alias("levels"))
        parts.append(cut(each.groupBy("k1", "k2").agg(F.first("levels").alias("levels"))))
        sent.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.collect_list("levels").alias("levels"))
    own = docs.select(F.struct(*keys).alias("own"), F.col(text_col).alias("text"), *content_key(text))
    out = cut(own.join(every, ["k1", "k2"]).select("own", "text", "levels"))
    return out, [F.col(f"own.{n}").alias(n) for n in _names(docs, keys)], "text"


def _names(docs: DataFrame, keys: list[Column]) -> list[str]:
    return docs.select(*keys).columns


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 10) == 0
    out, total, _ = score(docs, docs.where(~held), [F.col("doc_id"), held.alias("held_out")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
