"""Encoding against all segmentations, decoding against the library, and round trips."""

import random
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece

from coloom.llm import pieces
from coloom.llm.pieces import BYTE, MARKER, NORMAL, UNKNOWN, Pieces


def best_score(model, text):
    """The largest sum of scores over all segmentations of a text, by recursion over characters."""
    words = {model.pieces[i]: model.scores[i] for i in range(len(model.pieces)) if model.text[i] and i not in model.back}
    chars = [c.encode() for c in " " + text]
    chars = [MARKER if c == b" " else c for c in chars]

    @lru_cache(None)
    def best(at):
        if at == len(chars):
            return 0.0
        options = [words[w] + best(to) for to in range(at + 1, min(len(chars), at + 20) + 1) if (w := b"".join(chars[at:to])) in words]
        if chars[at] not in words:
            options.append(model.lowest - 10 + best(at + 1))
        return max(options)

    return best(0)


def cost(model, ids):
    """The sum of scores of ids; a character in bytes counts once."""
    spelt = b"".join(model.back.get(i, b"") for i in ids).decode()
    return sum(model.scores[i] for i in ids if i not in model.back) + len(spelt) * (model.lowest - 10)


def ids_of(model, text):
    return np.frombuffer(model.encode(text if isinstance(text, bytes) else text.encode()), "<i4").tolist()


@pytest.fixture(scope="module")
def model():
    return Pieces.load(pieces.VOCABULARY)


def small():
    words = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab", "▁▁", "é"]
    scores = [-3.0, -2.0, -2.5, -3.1, -2.2, -4.0, -3.0, -3.5, -3.2, -6.0]
    names = ["<unk>", "<s>", *(f"<0x{i:02X}>" for i in range(256)), *words]
    return Pieces(names, [0.0] * 258 + scores, [UNKNOWN, 0] + [BYTE] * 256 + [NORMAL] * len(words))


@pytest.mark.parametrize("seed", range(8))
def test_best_path(seed):
    rng, m = random.Random(seed), small()
    for _ in range(60):
        text = "".join(rng.choice("ab é\nc ") for _ in range(rng.randint(1, 14)))
        ids = ids_of(m, text)
        assert m.decode(ids) == text.encode()
        assert abs(cost(m, ids) - best_score(m, text)) < 1e-9


def test_best_path_of_the_vocabulary(model):
    for text in ["The quick brown fox", "naïve  café\n\ttabs", "日本語テキスト", "x" * 30]:
        assert abs(cost(model, ids_of(model, text)) - best_score(model, text)) < 1e-3


def test_every_piece_is_in_the_trie(model):
    for i, p in enumerate(model.pieces):
        if model.text[i] and i not in model.back:
            assert dict(model.trie.prefixes(p, 0))[len(p)] == i


@pytest.mark.parametrize(
    "text",
    ["", " ", "   ", "a", " a", "a ", "▁", "▁▁ a▁b", " ▁", "<s></s><unk><0x41>", "é\x00\r\n", "🎉 ok", "a" * 5000, "word " * 3000, b"\xff\xfe ab \xe2\x96", b"\xe2\x96\x81\x81"],
)
def test_round_trip(model, text):
    raw = text if isinstance(text, bytes) else text.encode()
    assert model.decode(ids_of(model, raw)) == raw


def test_library_decodes_the_same(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    for text in ["Hello  world", "naïve café 日本語\nnext", "tabs\tand 🎉"]:
        assert lib.decode(ids_of(model, text)) == text


def test_without_byte_pieces():
    m = Pieces(["<unk>", "▁a", "b"], [0.0, -1.0, -2.0], [UNKNOWN, NORMAL, NORMAL])
    assert ids_of(m, "abz") == [1, 2, 0]


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "▁ x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    out = docs.select("doc_id", "text", pieces.encode_column(spark, "text").alias("ids"))
    out = out.withColumn("back", pieces.decode_column(spark, out.ids)).collect()
    assert [bytes(r.back).decode() for r in out] == [r[1] or "" for r in rows]
    assert [len(r.ids) for r in out][:2] == [0, 0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = pieces.op4_sentencepiece(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.round_trip for r in out)
