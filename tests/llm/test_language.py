"""Codes, and accuracy on rows that were not learnt from."""

import zlib

import numpy as np
import pytest

from coloom.llm import language as L


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_differ(n):
    code = L.codewords(n)
    gaps = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)]
    assert set(np.unique(code)) <= {-1.0, 1.0} and gaps.min() >= (1 if n == 2 else 2 if n == 3 else 4)
    assert (np.abs(code.sum(0)) < n).all()


def test_wrong_bits_are_corrected():
    code = L.codewords(5)
    coder = L.Coder([str(i) for i in range(5)], code, np.zeros((code.shape[1], L.DIMS)), np.zeros(code.shape[1]))
    for i in range(5):
        margins = code[i] * 2.0
        margins[[0, 3, 5]] *= -1
        assert coder.decide(margins[None])[0][0] == i


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = L.op10_language_id(spark, sf).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_edge_rows(spark):
    rows = [(i, f"der die das {i} und nicht", "de", 1) for i in range(30)] + [(100 + i, f"the and of {i} with not", "en", 1) for i in range(30)]
    rows += [(200, None, "de", 1), (201, "", None, 1), (202, "123 !?", "en", 1), (203, "日本", None, 1), (None, "the and", None, 1), (204, "the and of " * 200000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, p int")
    coder = L.learn(docs, "doc_id", "text", "lang")
    out = {r.doc_id: r.p for r in docs.select("doc_id", L.predict_column(coder, "text").alias("p")).collect()}
    assert [out[i].lang for i in (200, 201, 202)] == ["und"] * 3 and out[200].score == 0
    assert out[None].lang == out[204].lang == "en" and out[203].lang in ("de", "en")
    assert all(out[i].lang == "de" for i in range(30))
    nobody = L.learn(docs.where("lang is null"), "doc_id", "text", "lang")
    assert {r.p.lang for r in docs.select(L.predict_column(nobody, "text").alias("p")).collect()} == {"und"}
    one = L.learn(docs.where("lang = 'de'"), "doc_id", "text", "lang")
    assert {(r.p.lang, r.p.score) for r in docs.where("doc_id < 200").select(L.predict_column(one, "text").alias("p")).collect()} == {("de", 1.0)}
