"""Benchmark matches against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from coloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def slow(text, items, width):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(width, len(v))
        for k in range(len(v) - n + 1 if v and item is not None else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
    return len(w), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_against_plain_search(spark, block_words):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["É", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(3, text(5)), (20, ""), (21, None), (None, "w1 w2"), (22, "Only-Here w1."), (22, "Only-Here w1.")]
    texts = [None, "", "!!", "w1", *(text(rng.randint(1, 40)) for _ in range(40)), items[0][1], "only here, W1!", "only here, W1!", text(3000)]
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as key", "2 as spans")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item")
    out = D.matches(docs, [F.col("doc_id")], bench, width=4, block_words=block_words).collect()
    got = sorted((r.key.doc_id, r.n_words, [p for s in r.spans for p in range(s.a, s.b)], sorted(r["items"])) for r in out)
    assert got == sorted((i % 40, *slow(t, items, 4)) for i, t in enumerate(texts))


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "gamma x x alpha x beta"), (2, "gamma " + "x " * 50 + "alpha beta"), (3, "alpha"), (4, "beta gamma"), (5, "alpha beta gamma")], "doc_id long, text string")
    out = {r.key.doc_id: (r["items"], r.near) for r in D.matches(docs, [F.col("doc_id")], bench, slop=5).collect()}
    assert out == {1: ([], ["1"]), 2: ([], []), 3: ([], []), 4: ([], []), 5: (["1"], ["1"])}


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in D.matches(docs, [F.col("doc_id")], bench).collect()] == [2]
    assert D.matches(docs.limit(0), [F.col("doc_id")], bench).count() == 0
