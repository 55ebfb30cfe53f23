"""The language model against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coloom.llm import lm


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b" "]


def slow(texts, train):
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)) for x in texts]
    return n, base, [sum(counts[t] > 0 for t in tokens(x)) for x in texts]


@pytest.mark.parametrize("most_mb", [128, 0])
def test_query(spark, most_mb):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [*docs.collect(), (-1, None), (-2, ""), (-2, ""), (-3, "Unseen zzzqq words")]
    df = spark.createDataFrame(rows, docs.schema).selectExpr("*", "1 as score")
    held = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    fold = lm.remainder("doc_id", 10) == 0
    out, total, _ = lm.score(df, df.where(~fold), [F.col("doc_id"), fold.alias("held_out")], most_mb=most_mb)
    got = sorted(out.collect(), key=lambda r: (r.doc_id, r.base_score))
    n, base, known = slow([r[1] for r in rows], [r[1] for r, h in zip(rows, held, strict=True) if not h])
    want = sorted(zip([r[0] for r in rows], held, base, known, [len(tokens(r[1])) for r in rows], strict=True), key=lambda r: (r[0], r[2]))
    assert total == n and len(got) == len(want)
    for r, (i, h, b, k, size) in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known) == (i, h, size, k)
        assert abs(r.base_score - b) < 1e-6 * max(1, -b) and r.score <= 0
    if most_mb:
        mine = lm.op9_lm_scoring(spark, sf).collect()
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_filter_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2))
    counts = rng.zipf(1.6, len(keys)).clip(max=10**6)
    f = lm.Filter.of(60, 0, [0] * 16, [])
    shift = 60
    rows = []
    for b in range(16):
        mine = lm.ranges(keys, shift) == b
        rows.append({"bucket": b, "block": lm.block(keys[mine], counts[mine], 14.0)})
    f = lm.Filter.of(shift, 0, [len(r["block"]) for r in rows], rows)
    read = f.counts(keys)
    # An entry is never lost: the level read is the stored one or, by error, a higher one.
    assert (read >= lm.level_means()[lm.level(counts)]).all()
    assert (read == lm.level_means()[lm.level(counts)]).mean() > 0.98
    absent = keys + np.uint64(1)
    assert (f.counts(absent) > 0).mean() < 0.02


def test_packing():
    keys = np.array([0, 5, 2**63 + 9, 2**64 - 1], np.uint64)
    k, c = lm.unpack(*lm.pack(keys, np.array([1, 2, 3, 4])))
    assert (k == keys).all() and c.tolist() == [1, 2, 3, 4]


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out, total, distinct = lm.score(df, df.limit(0), [F.col("doc_id")])
    r = out.first()
    assert (total, distinct, r.n_tokens, r.n_known) == (0, 0, 3, 0)
