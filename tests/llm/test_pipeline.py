"""Each stage of the pipeline against a plain version, and rows that are out of the ordinary."""

import corpus_pipeline as P
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_pii import base

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def replaced(text):
    out, at = [], 0
    for kind, a, b in sorted(base(text), key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def test_stages(spark):
    from tests.llm.test_jaccard import slow_components as near_copies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns

    kept = P.language_id(spark, docs, SF)
    assert kept.columns == columns
    before, now = texts(docs), texts(kept)
    assert len(now) >= 0.99 * len(before)

    unique = P.simhash_near_dedup(spark, kept, SF)
    assert unique.columns == columns and set(texts(unique)) == set(near_copies(sorted(now.items())))

    clean = P.benchmark_decontamination(spark, unique, SF)
    now = texts(unique)
    assert clean.columns == columns
    assert texts(clean) == {i: t for i, t in now.items() if not slow_hits(t, bench, 10)[1]}

    private = P.personal_data(spark, clean, SF)
    assert private.columns == columns
    now = texts(clean)
    rows = {r.doc_id: r for r in private.collect()}
    assert {i: r.text for i, r in rows.items()} == {i: replaced(t) for i, t in now.items()}
    assert all(r.n_chars == len(r.text) for r in rows.values())

    last = P.sentencepiece(spark, private, SF).collect()
    assert {r.doc_id: r.text for r in last} == {i: r.text for i, r in rows.items()}
    assert all(r.n_ids == len(r.ids) > 0 for r in last)


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, own int, k1 string, r1 int, copy int, p string"
    word = "the and of it with that"
    rows = [
        (1, f"{word} one", "en", "a", 1, 1, "x", 1, 1, "p"),
        (1, f"{word} one", "en", "a", 1, 1, "x", 1, 1, "p"),
        (2, None, "en", None, None, None, None, None, None, None),
        (3, "", None, "a", 0, 1, "x", 1, 1, "p"),
        (4, "der die und das ist nicht zwei", "de", "a", 1, 1, "x", 1, 1, "p"),
        (None, "the words of nobody with x@y.zz in it", None, "a", 1, 1, "x", 1, 1, "p"),
        (6, "12 34", "en", "a", 1, 1, "x", 1, 1, "p"),
    ]
    docs = spark.createDataFrame(rows, schema)
    for frame, ids in ((docs, {1, 4, None}), (docs.limit(0), set())):
        for _, stage in P.STAGES:
            frame = spark.createDataFrame(frame.collect(), frame.schema)
            frame = stage(spark, frame, SF)
        got = frame.collect()
        assert {r.doc_id for r in got} == ids and len(got) == len(ids)
        assert all(r.text == "the words of nobody with [email] in it" for r in got if r.doc_id is None)


def test_pieces_leave_in_small_batches(spark, monkeypatch):
    """Ids and texts of a batch are not kept until its last row, and rows stay as they are."""
    from coloom.llm import pieces

    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    rows = [(i, None, "s", None if i % 7 == 0 else f"text {i} \u2581 of x\u00e9 " * (i % 5)) for i in range(200)] + [(None, "en", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1)
    got = pieces.in_pieces(spark, docs, "text").collect()
    assert [(r.doc_id, r.lang, r.source, bytes(r.text).decode()) for r in got] == [(a, b, c, d or "") for a, b, c, d in rows]
    assert {r.doc_id: r.ids for r in got} == {r.doc_id: r.ids for r in docs.select("doc_id", pieces.encode_column(spark, "text").alias("ids")).collect()}
