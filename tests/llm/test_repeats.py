"""Repeated windows against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from coloom.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(texts, depth):
    """(n_words, n_removed, kept) of each text."""
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + depth]) for w in lists for i in range(len(w) - depth + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - depth + 1):
            if seen[tuple(w[i : i + depth])] > 1:
                gone[i : i + depth] = [True] * depth
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def fast(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 as k1", "2 as runs")
    cleaned = repeats.repeats(docs, **how).select("k1", "k2", repeats.kept_column(how["depth"]).alias("r")).select("k1", "k2", "r.*")
    keys = docs.select("doc_id", *repeats.content_key(repeats.raw("text")))
    rows = keys.join(cleaned, ["k1", "k2"]).collect()
    assert len(rows) == len(texts)
    return [(r.n_words, r.n_removed, r.kept.decode()) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("depth,gram,group", [(8, 3, 1000), (8, 3, 1), (8, 3, 3), (5, 5, 2), (6, 1, 1000)])
def test_against_all_windows(spark, depth, gram, group):
    rng = random.Random(depth * 10 + group)
    passages = [[f"p{i}w{rng.randint(0, 5)}" for _ in range(rng.randint(4, 30))] for i in range(6)]
    texts = [None, "", "  ", "one", "a b c d e f g h", "a b c d e f g h", "same " * 40, "é ü " * 3]
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += rng.choice([rng.choice(passages), [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 20))]])
        texts.append(" ".join(words) + rng.choice(["", "\n", "\t\tx"]))
    assert fast(spark, texts, depth=depth, gram=gram, group=group) == slow(texts, depth)


def test_long_text_and_no_rows(spark):
    rng = random.Random(4)
    words = [f"v{rng.randint(0, 10**6)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join(words[100:200]), " ".join(words[5000:5034])]
    assert fast(spark, texts, depth=35, gram=5, group=1000) == slow(texts, 35)
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert repeats.repeats(empty).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = slow([d.text for d in docs], 35)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op3_substring_dedup(spark, sf).collect()}
    assert got == {d.doc_id: (n, m, hashlib.sha256(k.encode()).hexdigest()) for d, (n, m, k) in zip(docs, want, strict=True)}
