"""The training sample where ids are shared, and the stage without labels."""

import corpus_pipeline as P
from coloom.llm import language


def test_shared_ids(spark, monkeypatch):
    sizes = {}
    fit = language.fit

    def seen(x, labels, **kw):
        sizes.update({v: labels.count(v) for v in labels})
        return fit(x, labels, **kw)

    monkeypatch.setattr(language, "fit", seen)
    rows = [(i % 2 or None, f"the text of number{i} and the rest", "en") for i in range(300)]
    rows += [(7, f"der text von nummer{i} und der rest", "de") for i in range(300)] + [(None, "le mot", "fr")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.learn(docs, "doc_id", "text", "lang", per_language=40)
    assert sizes == {"en": 40, "de": 40, "fr": 1}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "the words", None), (2, "12 34", None), (3, None, None), (4, "ß", None)], "doc_id long, text string, lang string")
    kept = P.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}
