"""Scores do not depend on the rounds in which the filter goes out."""

from pyspark.sql import functions as F

from coloom.llm import lm


def test_same_scores_at_every_bound(spark):
    rows = [(1, "a " * 2000 + "b c"), (2, "b a"), (-1, None), (-2, ""), (-3, "a zzzqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    train = docs.where("doc_id > 0")
    want, got = (
        {r.doc_id: r for r in lm.score(docs, train, [F.col("doc_id")], most_mb=most)[0].collect()} for most in (128, 0)
    )
    assert want.keys() == got.keys()
    for i, r in want.items():
        assert (r.n_tokens, r.n_known) == (got[i].n_tokens, got[i].n_known)
        assert abs(r.score - got[i].score) <= 1e-9 * max(1, -r.score)
        assert abs(r.base_score - got[i].base_score) <= 1e-9 * max(1, -r.base_score)
