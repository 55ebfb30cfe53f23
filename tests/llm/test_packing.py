"""Pieces against the library, the plan against best fit piece by piece, places against the rules."""

import random
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coloom.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", "   ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ. İstanbul ǅ é ́x y z \x1ca\x1fb 中文ABC123'll don't", "x" * 5000 + " é1" * 3000, "a ́b ᄀ ᅡ ﬁ Å ſ ẞ ​ q‍z", "\t\x0b\x0c\r\n w\x85v"]


def slow_plan(lengths, most):
    """Sequences of best fit, decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else most
        insort(rooms, room - n)
    return sorted(most - r for r in rooms)


def filled(rows, most):
    """{sequence: tokens}; each is gapless from 0."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    out = {}
    for seq, parts in held.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
        out[seq] = at
    return out


def ids_of(words, texts):
    found = words.of_batch(pa.array([t.encode() for t in texts], pa.binary()))
    assert found.sizes.sum() == len(found.flat)
    return [found.flat[a : a + n].tobytes() for a, n in zip(found.first, found.sizes)]


def test_word_ids():
    words = K.WordIds(PATH)
    assert words.cuts
    rnd = random.Random(1)
    letters = [chr(c) for c in (*range(33, 127), *range(192, 256))] + list("aeiousaeiou") + ["'", "²", "×", "ª", "Ÿ", "中"]
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(6000)]
    for texts in (ODD * 2, made, [" ".join(made)], [], [""]):
        assert ids_of(words, texts) == [words.of_text(t) for t in texts]
    other = K.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.cuts


def test_few_remembered(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 5)
    words = K.WordIds(PATH)
    for t in ODD + ["one two three four five six seven", "seven eight nine"]:
        assert ids_of(words, [t]) == [words.of_text(t)]


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rnd = random.Random(seed)
    most = rnd.choice((1, 7, 30, 100))
    lengths = [rnd.choice((rnd.randint(1, most), max(1, most // rnd.randint(1, 4)))) for _ in range(rnd.choice((1, 50, 900)))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    lines, opened = K.plan(counts, most)
    want = slow_plan(lengths, most)
    got = {}
    for (length, first, seq, offset), (after, second, _, _) in zip(lines, [*lines[1:], (0, 0, 0, 0)]):
        n = (second if after == length else counts[length]) - first
        for k in range(n):
            got.setdefault(seq + k, []).append((offset, length))
    assert len(got) == opened == len(want)
    ends = []
    for parts in got.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        ends.append(at)
    assert sorted(ends) == want
    assert K.plan({}, most)[1] == 0


def test_pack(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, None, "x", 1), (3, None, None, 2)] + [(7, "same words here", "y", 3)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, length int")
    packed = K.pack(docs, PATH, most=64)
    found = packed.collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((-1 if i is None else i, *library.encode(t or "", add_special_tokens=False).ids, 0) for i, t, _, _ in rows)
    whole, got = {}, []
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64
        whole.setdefault(-1 if r.id is None else r.id, []).append((r.piece, r.start, ids))
    for i, parts in whole.items():
        for piece, start, ids in parts:
            assert start == 64 * piece
        if i != 3 and i != 7:
            got.append((i, *[x for p in sorted(parts) for x in p[2]]))
    assert sorted(got) == [w for w in want if w[0] not in (3, 7)]
    held = filled(found, 64)
    assert sorted(held) == list(range(len(slow_plan([r.length for r in found], 64))))
    by = {r.sequence_id: r for r in K.sequences(packed).collect()}
    assert {s: len(r.ids) // 4 for s, r in by.items()} == held
    assert sum(len(r.spans) for r in by.values()) == len(found)
    assert K.pack(docs.limit(0), PATH).count() == 0


def test_query(spark):
    found = K.op13_best_fit_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    library = Tokenizer.from_file(PATH)
    import zlib

    want = set()
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want.add((r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want and len(want) == len(found)
    assert len(filled(found, 2048)) == len(slow_plan([r.length for r in found], 2048))


def test_one_length(spark):
    """Pieces of one length are ranked in many tasks; every place is taken once."""
    rows = spark.range(5000, numPartitions=8).select("id", F.lit(3).alias("length"))
    found = K.place(rows, 10)
    assert len({(r.sequence_id, r.offset) for r in found.collect()}) == 5000
    assert sorted(filled(found.collect(), 10).values()) == [6] + [9] * 1666
    with pytest.raises(ValueError):
        K.place(rows.withColumn("_rank", F.lit(1)))
